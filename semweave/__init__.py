"""semweave: embedding-similarity graph analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by an explicit id column.
Nothing is collected to the driver except small scalars (a threshold, a
centroid table of a declared size, convergence counters).
"""

from semweave.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
