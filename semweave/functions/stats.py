"""Exact quantiles by radix selection, without gathering a column in one task.

Spark's exact ``percentile`` aggregate keeps a map of every distinct value
in one buffer, which is fine for small domains (word counts, degrees) but
not for billions of distinct doubles. :func:`exact_quantiles` reads the 64
bits of a double so that their order as an unsigned number is the order of
the values, and finds the wanted order statistics digit by digit: a pass
counts, per partition, the 65,536 values of the next 16 bits behind each
prefix found so far; four passes give all ranks together, whatever the
number of rows or distinct values. What is shuffled and what reaches the
driver is at most 65,536 counts a wanted rank. Interpolation between the
two neighbouring order statistics matches ``numpy.percentile``'s default.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.session import drop_materialized, materialize, ship_package

DIGIT = 16
_SIGN = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles (-0.0 as 0.0, NaN last)."""
    b = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.uint64)
    return np.where(b & _SIGN, ~b, b | _SIGN)


def from_bits(k: int) -> float:
    k = np.uint64(k)
    b = k & ~_SIGN if k & _SIGN else ~k
    return float(np.array([b], np.uint64).view(np.float64)[0])


def _digit_counts(df: DataFrame, shift: int, prefixes: np.ndarray) -> DataFrame:
    """``(p, digit, n)``: rows behind prefix number ``p`` by their next digit."""
    width = 1 << DIGIT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(prefixes) * width, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            k = ordered_bits(b.column(0).to_numpy(zero_copy_only=False))
            digit = ((k >> np.uint64(shift)) & np.uint64(width - 1)).astype(np.int64)
            if shift + DIGIT < 64:
                high = k >> np.uint64(shift + DIGIT)
                p = np.minimum(np.searchsorted(prefixes, high), len(prefixes) - 1)
                hit = prefixes[p] == high
                digit = digit[hit] + p[hit] * width
            total += np.bincount(digit, minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)),
                                              pa.array(total[at])], ["p", "digit", "n"])

    return df.mapInArrow(count, "p int, digit int, n long").groupBy("p", "digit").agg(F.sum("n").alias("n"))


def order_statistics(values: DataFrame, ranks: list[int] | None = None, qs: list[float] | None = None) -> dict[int, float]:
    """The values of the given 0-based ranks of a table of one double column without nulls.

    With ``qs`` the ranks are those around the quantiles; the key -1 then
    holds the number of rows.
    """
    width = 1 << DIGIT
    found: dict[int, tuple[int, int]] = {}  # rank -> (bits so far, rank behind them)
    out: dict[int, float] = {}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        prefixes = np.array(sorted({b for b, _ in found.values()}) or [0], np.uint64)
        table = np.zeros((len(prefixes), width), np.int64)
        for r in _digit_counts(values, shift, prefixes).collect():  # at most 65,536 counts a prefix
            table[r["p"], r["digit"]] = r["n"]
        if shift == 64 - DIGIT:
            n = int(table.sum())
            if qs is not None:
                out[-1] = n
                ranks = sorted({x for q in qs for x in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}) if n else []
            if any(not 0 <= r < n for r in ranks):
                raise ValueError(f"a rank outside 0..{n - 1}")
            found = {r: (0, r) for r in ranks}
        below = table.cumsum(1)
        for r, (bits, rest) in found.items():
            row = below[int(np.searchsorted(prefixes, np.uint64(bits)))]
            digit = int(np.searchsorted(row, rest, side="right"))
            found[r] = ((bits << DIGIT) | digit, rest - (int(row[digit - 1]) if digit else 0))
        if not found:
            break
    return out | {r: from_bits(bits) for r, (bits, _) in found.items()}


def exact_quantiles(df: DataFrame, col: str, qs: list[float], max_exact: int | None = None) -> list[float | None]:
    """Exact, interpolated quantiles of a numeric column (nulls ignored).

    The column alone is written once and read four times. ``max_exact`` has
    no effect any more: there is one way for all sizes.
    """
    ship_package(df.sparkSession)
    base = materialize(df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull()), "quantiles")
    at = order_statistics(base, qs=qs)
    drop_materialized(base)
    n = at[-1]
    if n == 0:
        return [None for _ in qs]
    out = []
    for q in qs:
        h = (n - 1) * q
        v0, v1 = at[math.floor(h)], at[math.ceil(h)]
        out.append(v0 if v0 == v1 else v0 + (h - math.floor(h)) * (v1 - v0))
    return out
