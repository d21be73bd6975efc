"""Rows that share a key, cut into bounded blocks and dealt out as block pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.llm.common import as_batch

BLOCK = 512


def cut_into_blocks(rows: DataFrame, similarity: int = 0) -> DataFrame:
    """``(key, part, block, id)`` of the rows ``(key, n, id)`` whose key has another row of a fitting size.

    A stretch is a run of one key, by size, without a gap that no pair of
    sizes within ``similarity`` per cent can span; it is cut into blocks of
    ``BLOCK`` rows. Repeated rows count once. The rows are read as a stream;
    only the last one and its counters are held, whatever the length of a run.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("key", "part", "block", "id")])

    def run(batches):
        held = None  # the last row so far, whose successor isn't known
        fit, place, part = False, 0, 0  # of that row: fits its predecessor; place in its stretch; stretch of its key
        for b in batches:
            if not b.num_rows:
                continue
            key, n, ident = (b.column(k).to_numpy() for k in range(3))
            if held is not None:
                key, n, ident = (np.append(h, x) for h, x in zip(held, (key, n, ident), strict=True))
            again = np.append(False, (key[1:] == key[:-1]) & (n[1:] == n[:-1]) & (ident[1:] == ident[:-1]))
            if again.any():
                key, n, ident = key[~again], n[~again], ident[~again]
            at = np.arange(len(key))
            same = np.append(True, key[1:] == key[:-1])
            fits = same & np.append(True, 100 * n[:-1] >= similarity * n[1:])
            fits[0] = fit
            begin = np.where(fits, -2 ** 62, at)
            begin[0] = -place
            place_of = at - np.maximum.accumulate(begin)
            gaps = np.cumsum(same & ~fits) - (not fit)
            base = np.where(same, -2 ** 62, gaps)
            base[0] = -part
            part_of = gaps - np.maximum.accumulate(base)
            out = np.flatnonzero(fits[:-1] | fits[1:])
            if len(out):
                yield as_batch({"key": key[out], "part": part_of[out], "block": place_of[out] // BLOCK,
                                "id": ident[out]}, schema)
            held, fit = (key[-1:], n[-1:], ident[-1:]), bool(fits[-1])
            place, part = int(place_of[-1]), int(part_of[-1])
        if held is not None and fit:
            yield as_batch({"key": held[0], "part": [part], "block": [place // BLOCK], "id": held[2]}, schema)

    dealt = rows.repartition("key").sortWithinPartitions("key", "n", "id")
    return dealt.mapInArrow(run, "key long, part long, block long, id long")


def block_pairs(rows: DataFrame) -> DataFrame:
    """Each row once for every block pair of its stretch that it belongs to: ``(key, part, b1, b2, block, id)``."""
    tops = (rows.where("block > 0").groupBy("key", "part").agg(F.max("block").alias("top"))
            .select(F.col("key").alias("_k"), F.col("part").alias("_p"), "top"))
    j = rows.join(tops, (rows["key"] == tops["_k"]) & (rows["part"] == tops["_p"]), "left")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("top", F.lit(0).cast("long"))))
    j = j.select("key", "part", "block", "id", other.alias("other"))
    return j.select("key", "part", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"),
                    "block", "id")
