"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Each source has an integer share; the shares add up to the length D of a
cycle of slots. The k-th block of a source with share d is released at slot
floor(k D / d) and due by slot ceil((k + 1) D / d). Earliest deadline first
among the released blocks meets every deadline (the shares fill the cycle
exactly), so at any slot a source has had its share of blocks but for less
than one block. The cycle is worked out once, as one SQL expression over the
array of shares; block k of a source then stands at slot
(k div d) * D + place of its block k mod d in the cycle.

Documents of a source are taken in the order of md5(id), a fixed shuffle.
Their numbers come from row numbers inside (source, first four hex digits)
plus running counts over the digits, so a source that holds a third of all
rows is 65,536 small groups, and the running counts are at most as many rows
a source. No row is left out: where a source has run out, its slots stay
empty and the others go on in their proportions; ``on_target`` tells the
slots before that.

A null source counts as the empty one. Null ids are taken as the text 'null';
rows of a repeated id get places next to each other, in the order of their
texts' hashes. An empty table gives an empty result. ``source`` and the id
are read; further columns are kept unless named like a result column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from semweave.session import materialize

BLOCK_DOCS = 16
CYCLE = 1000  # about; each source gets at least one slot


def shares_by_size(counts: DataFrame, power: float = 0.5, cycle: int = CYCLE) -> DataFrame:
    """``(src, share)`` from ``(src, n)``: in proportion to n ** power, at least 1."""
    total = F.sum(F.pow("n", F.lit(power))).over(W.partitionBy(F.lit(1)))
    share = F.greatest(F.lit(1), F.round(F.lit(float(cycle)) * F.pow("n", F.lit(power)) / total)).cast("long")
    return counts.select("src", share.alias("share"))


def cycle_table(shares: DataFrame) -> DataFrame:
    """``(src, share, cycle, nth, place)``: the slot of each source's nth block in a cycle, earliest deadline first."""
    one = shares.agg(F.array_sort(F.collect_list(F.struct("src", "share"))).alias("s")).select(
        F.col("s.src").alias("src"), F.col("s.share").alias("d"),
        F.aggregate("s.share", F.lit(0).cast("long"), lambda a, x: a + x).alias("cycle")).where("cycle > 0")
    # per slot: of the sources whose next block is released, the one with the earliest deadline
    plan = F.expr("""
        aggregate(sequence(0L, cycle - 1),
          named_struct('done', transform(d, x -> 0L), 'plan', cast(array() as array<int>)),
          (s, t) -> transform(
            array(cast(array_min(transform(d, (x, i) -> if(s.done[i] * cycle div x <= t,
              ((s.done[i] + 1) * cycle + x - 1) div x * size(d) + i, 9000000000000000000L))) % size(d) as int)),
            p -> named_struct('done', transform(s.done, (x, i) -> if(i = p, x + 1, x)), 'plan', s.plan || array(p)))[0],
          s -> s.plan)
    """)
    slots = one.select("src", "d", "cycle", F.posexplode(plan).alias("place", "i"))
    nth = F.row_number().over(W.partitionBy("i").orderBy("place")) - 1
    return slots.select(F.col("src")[F.col("i")].alias("src"), F.col("d")[F.col("i")].alias("share"), "cycle",
                        nth.cast("long").alias("nth"), F.col("place").cast("long").alias("place"))


def mix_sources(docs: DataFrame, shares: DataFrame | None = None, block_docs: int = BLOCK_DOCS,
                id_col: str = "doc_id", source_col: str = "source", text_col: str | None = None) -> DataFrame:
    """``docs`` with ``block, slot, position, on_target``; ``position`` orders the mix.

    ``shares(src, share)``: integer target weights for every source; by
    default in proportion to the square root of the sources' sizes.
    """
    names = [c for c in docs.columns if c not in ("block", "slot", "position", "on_target")]
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    keyed = docs.select(*names, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_sw_src"),
                        order.alias("_sw_md5")).withColumn("_sw_lot", F.substring("_sw_md5", 1, 4))
    tie = [F.xxhash64(text_col)] if text_col else []
    lots = materialize(keyed.groupBy(F.col("_sw_src").alias("src"), F.col("_sw_lot").alias("lot"))
                       .agg(F.count(F.lit(1)).alias("c")), "mix_lots")
    sizes = lots.groupBy("src").agg(F.sum("c").alias("n"))
    shares = shares_by_size(sizes) if shares is None else shares
    cycle = materialize(cycle_table(shares), "mix_cycle")  # about CYCLE rows and one a source
    before = F.sum("c").over(W.partitionBy("src").orderBy("lot").rowsBetween(W.unboundedPreceding, -1))
    starts = lots.select(F.col("src").alias("_s"), F.col("lot").alias("_l"), F.coalesce(before, F.lit(0)).alias("_b"))
    last = (sizes.join(cycle.select("src", "share", "cycle", "nth", "place"), "src")
            .where(((F.col("n") - 1) / block_docs).cast("long") % F.col("share") == F.col("nth"))
            .select((((F.col("n") - 1) / block_docs).cast("long") / F.col("share")).cast("long") * F.col("cycle")
                    + F.col("place"))).toDF("last")
    horizon = last.agg(F.min("last").alias("h")).first()["h"]
    rn = F.row_number().over(W.partitionBy("_sw_src", "_sw_lot").orderBy("_sw_md5", F.col(id_col), *tie))
    numbered = keyed.withColumn("_sw_rn", rn)
    j = numbered.join(starts, (numbered["_sw_src"] == starts["_s"]) & (numbered["_sw_lot"] == starts["_l"]))
    j = (j.withColumn("_sw_k", (F.col("_b") + F.col("_sw_rn") - 1).cast("long"))
         .withColumn("block", F.expr(f"_sw_k div {block_docs}")))
    c = cycle.select(F.col("src").alias("_c"), F.col("share").alias("_sh"), F.col("cycle").alias("_cy"),
                     F.col("nth").alias("_n"), F.col("place").alias("_pl"))
    share_of = c.groupBy("_c").agg(F.max("_sh").alias("_d")).withColumnRenamed("_c", "_c2")
    # a row a slot of the cycle, read from files of known size: Spark sends them to every task below its
    # broadcast threshold and shuffles beyond it
    j = j.join(share_of, j["_sw_src"] == share_of["_c2"])
    j = j.join(c, (F.col("_sw_src") == F.col("_c")) & (F.expr("block % _d") == F.col("_n")))
    j = j.withColumn("slot", F.expr("block div _d * _cy + _pl"))
    j = j.withColumn("position", F.expr(f"slot * {block_docs} + _sw_k % {block_docs}"))
    return j.select(*names, "block", "slot", "position", (F.col("slot") <= F.lit(horizon)).alias("on_target"))


#: DuckDB: the same order, shares and cycle, with the schedule as a recursive query.
MIX_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS src,
         row_number() OVER (PARTITION BY coalesce(source, '')
                            ORDER BY md5(coalesce(cast(doc_id AS varchar), 'null')), doc_id) - 1 AS k
  FROM documents),
n AS (SELECT src, count(*) AS n FROM d GROUP BY src),
s AS (SELECT src, n, cast(greatest(1, round({CYCLE}.0 * pow(n, 0.5) / sum(pow(n, 0.5)) OVER ())) AS bigint) AS share,
             row_number() OVER (ORDER BY src) AS i FROM n),
c AS (SELECT list(share ORDER BY i) AS ds, cast(sum(share) AS bigint) AS cycle, cast(count(*) AS bigint) AS m FROM s),
edf(t, done, pick) AS (
  SELECT cast(-1 AS bigint), list_transform(ds, lambda x: cast(0 AS bigint)), cast(0 AS bigint) FROM c
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p
  FROM (SELECT t, done, cycle, list_min(list_transform(ds, lambda x, i:
          CASE WHEN done[i] * cycle // x <= t + 1 THEN ((done[i] + 1) * cycle + x - 1) // x * m + i - 1
               ELSE 9000000000000000000 END)) % m + 1 AS p
        FROM edf, c WHERE t + 1 < cycle)),
pl AS (SELECT pick AS i, t AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM edf WHERE t >= 0),
o AS (SELECT d.doc_id, d.src, d.k // {BLOCK_DOCS} AS block, d.k % {BLOCK_DOCS} AS inside, s.share, s.i FROM d JOIN s USING (src)),
r AS (SELECT o.doc_id, o.src AS source, o.block, o.block // o.share * c.cycle + pl.place AS slot, o.inside
      FROM o, c, pl WHERE pl.i = o.i AND pl.nth = o.block % o.share),
h AS (SELECT min(m) AS h FROM (SELECT source, max(slot) AS m FROM r GROUP BY source))
SELECT doc_id, source, cast(block AS bigint) AS block, cast(slot AS bigint) AS slot,
       cast(slot * {BLOCK_DOCS} + inside AS bigint) AS position, slot <= h AS on_target
FROM r, h
"""
