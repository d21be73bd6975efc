"""Fixed-width histogram binning with literal bin edges.

Edges are ``i * step`` in double precision, which equals the edges of an
evenly spaced grid built with ``linspace(lo, hi, bins + 1)`` for lo = 0.
Intervals are ``[edge_i, edge_{i+1})`` except the last one, which is closed.
Values outside ``[lo, hi]`` get a null bin and are dropped by the callers.
``width_bucket`` is not used: its arithmetic disagrees with the literal
edges on some boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The distance histogram of the kNN step spans [0, 1.2] in 120 bins.
HIST_LO = 0.0
HIST_HI = 1.2
HIST_BINS = 120


def hist_step(hi: float = HIST_HI, bins: int = HIST_BINS) -> float:
    return hi / bins


def bin_edge(i, hi: float = HIST_HI, bins: int = HIST_BINS) -> Column:
    """Edge ``i`` as a double column."""
    i = F.col(i) if isinstance(i, str) else i
    return i.cast("double") * F.lit(hist_step(hi, bins))


def distance_bin(value, hi: float = HIST_HI, bins: int = HIST_BINS) -> Column:
    """Bin index in ``0..bins-1`` or null when the value is out of range."""
    v = F.col(value) if isinstance(value, str) else value
    step = F.lit(hist_step(hi, bins))
    guess = F.floor(v / step).cast("int")
    # correct the floating guess against the literal edges
    lo_edge = guess.cast("double") * step
    hi_edge = (guess + 1).cast("double") * step
    fixed = F.when(v < lo_edge, guess - 1).when(v >= hi_edge, guess + 1).otherwise(guess)
    fixed = F.least(fixed, F.lit(bins - 1))
    return F.when((v >= F.lit(HIST_LO)) & (v <= F.lit(hi)), fixed).otherwise(F.lit(None).cast("int"))
