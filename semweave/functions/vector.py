"""Vector expressions over ``array<float|double>`` columns.

These are the row-wise forms used for point look-ups and small candidate
sets; bulk all-pairs work goes through the block kernels in
``semweave.operators.knn`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Dot product in double precision."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def l2_normalize(a) -> Column:
    """Unit-length copy of a vector as ``array<double>``; a zero vector stays zero."""
    n = norm(a)
    return F.when(n == 0, F.transform(_c(a), lambda x: x.cast("double") * 0.0)) \
        .otherwise(F.transform(_c(a), lambda x: x.cast("double") / n))


def cosine_distance(a, b) -> Column:
    """``1 - cos(a, b)``; a zero vector is at distance 1 from everything."""
    denom = norm(a) * norm(b)
    return F.when(denom == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / denom)
