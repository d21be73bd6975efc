"""Print the formatted physical plan of registered queries.

Usage: python scripts/explain_plans.py [sf_dir] [name ...]
(iterative queries execute their earlier rounds while the plan is built).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from semweave.plans import catalog  # noqa: E402
from semweave.session import get_session  # noqa: E402

DEFAULT = ["eda_stats", "knn_exact", "graph_sweep", "graph_stats", "modularity_by_label",
           "recommend", "community_terms", "knn_ivf"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or DEFAULT
    spark = get_session("local[8]", 8)
    for name in names:
        print(f"===== {name}")
        catalog.QUERIES[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
