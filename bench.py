"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` (default 8): one warm-up run and the median of
three timed runs for the fast queries, a single timed run for the
iterative Louvain jobs. A run executes the whole plan through the no-op
sink (nothing is collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from semweave.plans import catalog  # noqa: E402
from semweave.session import get_session, release_materialized  # noqa: E402

FAST = ["eda_stats", "year_distribution", "length_histogram", "knn_exact", "knn_lookup",
        "distance_histogram", "tau_candidates", "graph_sweep", "graph_stats", "modularity_by_label",
        "coherence", "recommend", "knn_ivf", "embed_hashing", "community_terms"]
SLOW = ["knn_lsh", "knn_recall", "kmeans_labels", "louvain_duplicates", "louvain_knn", "louvain_sweep", "knn_append",
        "knn_lookup_index", "knn_descent"]


def run_once(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    df = catalog.QUERIES[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - t0
    release_materialized(spark)
    return took


def figures(spark, sf: str, times: dict[str, float]) -> dict[str, float]:
    """Rates and quality next to the seconds: pairs and rows a second, recall, Louvain rounds and modularity."""
    n = catalog.TB.load_table(spark, sf, "embeddings").count()
    docs = catalog.TB.load_table(spark, sf, "documents").count()
    out = {f"{q}_rows_per_s": round(docs / times[q]) for q in ("eda_stats", "year_distribution", "length_histogram",
                                                              "embed_hashing") if q in times}
    if "knn_exact" in times:
        out["knn_exact_pairs_per_s"] = round(n * n / times["knn_exact"])
    if "knn_recall" in times:
        for r in catalog.QUERIES["knn_recall"](spark, sf).collect():
            out[f"recall_nprobe_{r['nprobe']}"] = r["recall"]
    release_materialized(spark)
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", cpus * 2, app_name="semweave-bench")
    only = set(sys.argv[1:])
    times: dict[str, float] = {}
    for name in FAST:
        if only and name not in only:
            continue
        run_once(spark, name, sf)  # warm-up
        times[name] = round(statistics.median(run_once(spark, name, sf) for _ in range(3)), 3)
    for name in SLOW:
        if only and name not in only:
            continue
        times[name] = round(run_once(spark, name, sf), 3)
    sf_label = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_label, "cpus": cpus, "figures": figures(spark, sf, times)}))


if __name__ == "__main__":
    main()
