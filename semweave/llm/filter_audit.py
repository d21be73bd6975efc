"""Filter interaction audit: what each of five filters removes at each step of all 120 orders.

A document is reduced to the mask of the filters it fails; a part (source)
is then a histogram over at most 32 masks. In an order, a document falls at
the first letter of its mask. The orders that begin with a given run of
letters are neighbours among the 120 permutations in lexicographic order:
the Lehmer rank of the run times the factorials is the first of them, and
the factorial of the letters left is their number. So the orders in which a
mask falls at a given step are whole intervals of ranks, one per run of
letters outside the mask that is followed by a letter of the mask
(:func:`intervals`). The count of the mask is added at the start of each
interval and taken away behind its end, per (part, step); one running sum
over the 120 ranks turns these differences into the documents removed, in
every order at once. Everything else follows from that table: what is kept
is what is left after the steps so far, what is redundant is a filter's
failures less its removals, and the Shapley column adds the removals of a
letter over all orders.

Work that grows with the documents is one pass over the texts (a row of a
few bytes per document is written), one aggregate by text key for the
smallest id of each text, and two joins on keys that hold one row a document
(``(text key, id)`` and the id), so neither a text that a third of the
documents share nor a source that holds a third of them meets in one task.
The rest has at most 32 rows a part, or the 600 rows of the result.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 *
``[A-Z]`` characters > 5 * code points; D any of ``#$%&*|``; E the text is
equal to the text of a smaller id anywhere in the table.

A null text is the empty one (fails A, and E behind a smaller id with an
empty or null text). A null source is the part ''. A null id has no label,
never fails E and makes no other document fail it. Rows that share an id
count each; equal texts under the same id do not fail E by each other. Of
several labels of one id, any quality = 1 or toxic = 1 counts. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from semweave.session import materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, UPPER_SHARE = 50, 65, 5
MARKS = "[#$%&*|]"
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lehmer_rank(run: str, letters: str = FILTERS) -> int:
    """Rank of the first permutation of ``letters`` (sorted) that begins with ``run``."""
    left, rank = list(letters), 0
    for c in run:
        rank += left.index(c) * factorial(len(left) - 1)
        left.remove(c)
    return rank


def intervals(letters: str = FILTERS) -> list[tuple[int, int, str, int, int]]:
    """``(mask, step, letter, start, end)``: the orders ranked in [start, end) drop the mask's documents at this step.

    840 rows for five filters. Bit k of a mask stands for the k-th letter.
    """
    out = []
    for mask in range(1, 1 << len(letters)):
        outside = [c for k, c in enumerate(letters) if not mask >> k & 1]
        for passed in range(len(outside) + 1):
            for run in permutations(outside, passed):
                for k, c in enumerate(letters):
                    if mask >> k & 1:
                        start = lehmer_rank("".join(run) + c, letters)
                        out.append((mask, passed + 1, c, start, start + factorial(len(letters) - passed - 1)))
    return out


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """``(id, part, mask, key)`` per row: filters A to D by the text alone, and a 256-bit key of the text."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = slim.select("id", "part", "text", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"))
    upper = F.length("text") - F.length(F.translate("text", UPPER, ""))
    counted = words.select("id", "part", F.size("words").cast("long").alias("n"),
                           F.size(F.array_distinct("words")).cast("long").alias("d"),
                           upper.cast("long").alias("u"), F.length("text").cast("long").alias("chars"),
                           F.col("text").rlike(MARKS).alias("marked"), F.unhex(F.sha2("text", 256)).alias("key"))
    fails = [F.col("n") < MIN_WORDS, 100 * F.col("d") < DISTINCT_SHARE * F.col("n"),
             100 * F.col("u") > UPPER_SHARE * F.col("chars"), F.col("marked")]
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(fails)), F.lit(0))
    return counted.select("id", "part", mask.cast("int").alias("mask"), "key")


def mask_counts(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(part, mask, n, good, toxic)`` with the repeat filter E (bit 4) and the labels joined in."""
    anonymous = rows.where("id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    anonymous = anonymous.select("part", "mask", "n", F.lit(0).cast("long").alias("good"),
                                 F.lit(0).cast("long").alias("toxic"))
    known = rows.where("id is not null")
    # exact repeats of a row count as one row with their number
    known = known.groupBy("id", "key", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = known.groupBy(F.col("key").alias("k1")).agg(F.min("id").alias("first"))
    marks = labels.select(F.col(id_col).cast("long").alias("l1"), "quality", "toxic").where("l1 is not null")
    marks = marks.groupBy("l1").agg(F.max((F.col("quality") == 1).cast("long")).alias("q"),
                                    F.max((F.col("toxic") == 1).cast("long")).alias("t"))
    j = known.join(first, (known["key"] == first["k1"]) & (known["id"] == first["first"]), "left")
    j = j.join(marks, j["id"] == marks["l1"], "left")
    repeat = F.when(F.col("first").isNull(), F.lit(16)).otherwise(F.lit(0))
    counts = j.select("part", (F.col("mask") + repeat).alias("mask"), "n",
                      (F.coalesce("q", F.lit(0)) * F.col("n")).alias("good"),
                      (F.coalesce("t", F.lit(0)) * F.col("n")).alias("toxic"))
    return counts.unionByName(anonymous).groupBy("part", "mask").agg(
        *(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))


def audit(counts: DataFrame) -> DataFrame:
    """The audit of ``(part, mask, n, good, toxic)``: a row per part, order and step."""
    spark = counts.sparkSession
    measures = ["n", "good", "toxic"]
    # both tables are fixed: 840 intervals, 600 (order, step) pairs
    falls = spark.createDataFrame([(m, s, a, b) for m, s, _, a, b in intervals()],
                                  "mask int, step int, a int, b int")
    orders = [("".join(p), r) for r, p in enumerate(permutations(FILTERS))]
    grid = spark.createDataFrame([(o, r, s + 1, o[s]) for o, r in orders for s in range(len(FILTERS))],
                                 "filter_order string, rank int, step int, letter string")
    ends = F.explode(F.array(F.struct(F.col("a").alias("rank"), F.lit(1).alias("sign")),
                             F.struct(F.col("b").alias("rank"), F.lit(-1).alias("sign"))))
    events = counts.join(F.broadcast(falls), "mask").select("part", "step", *measures, ends.alias("e"))
    diff = events.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(
        *(F.sum(F.col(m) * F.col("e.sign")).alias(f"d_{m}") for m in measures))
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.col("n")).otherwise(0))
             for k in range(len(FILTERS))]
    only = [F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(FILTERS))]
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"),
                                        F.array(*only).alias("only"))
    cells = totals.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))))
    cells = cells.join(F.broadcast(grid), "rank").select(  # the 600 rows of each part's result
        F.col("part").alias("p1"), "total", "filter_order", F.col("rank").alias("r1"), F.col("step").alias("s1"), "letter",
        F.element_at("fails", F.ascii("letter") - F.lit(64)).alias("fails"),
        F.element_at("only", F.ascii("letter") - F.lit(64)).alias("only"))
    full = cells.join(diff, (cells["p1"] == diff["part"]) & (cells["s1"] == diff["step"])
                      & (cells["r1"] == diff["rank"]), "left")
    # 600 rows a part: dealt by part once, all windows run on that
    full = full.repartition("p1")
    ranks = W.partitionBy("p1", "s1").orderBy("r1").rowsBetween(W.unboundedPreceding, 0)
    removed = {m: F.sum(F.coalesce(f"d_{m}", F.lit(0))).over(ranks) for m in measures}
    full = full.select("p1", "total", "filter_order", "r1", "s1", "letter", "fails", "only",
                       *(c.cast("long").alias(f"gone_{m}") for m, c in removed.items()))
    steps = W.partitionBy("p1", "r1").orderBy("s1").rowsBetween(W.unboundedPreceding, 0)
    full = full.withColumn("kept", F.col("total") - F.sum("gone_n").over(steps))
    full = full.withColumn("shapley", F.sum("gone_n").over(W.partitionBy("p1", "letter")))
    return full.select(F.col("p1").alias("part"), "filter_order", F.col("s1").alias("step"),
                       F.col("kept").cast("long").alias("kept"), F.col("gone_n").alias("removed"),
                       (F.col("fails") - F.col("gone_n")).cast("long").alias("redundant"),
                       F.col("only").cast("long").alias("unique_fails"), F.col("gone_good").alias("good_lost"),
                       F.col("gone_toxic").alias("toxic_lost"), F.col("shapley").cast("long").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``."""
    rows = materialize(failures(docs, id_col, text_col, source_col), "audit_rows")
    counts = materialize(mask_counts(rows, labels, id_col), "audit_counts")
    return audit(counts)


#: DuckDB: every document is walked through every order, without intervals.
AUDIT_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(words) < {MIN_WORDS} AS a, 100 * len(list_distinct(words)) < {DISTINCT_SHARE} * len(words) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_SHARE} * length(text) AS c,
             regexp_matches(text, '{MARKS}') AS d, coalesce(doc_id > first, false) AS e,
             coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
                          CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
             count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, filter_order, step, letter, fails, n, good, toxic, contains(fails, letter) AS hit,
             len(list_filter(string_split(filter_order[1:step - 1], ''), lambda q: q <> '' AND contains(fails, q))) > 0 AS gone
      FROM m, s),
r AS (SELECT part, filter_order, step, letter,
             coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails,
             coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
      FROM g GROUP BY ALL)
SELECT part, filter_order, cast(step AS integer) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed,
       cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
       cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost,
       cast(sum(removed) OVER (PARTITION BY part, letter) AS bigint) AS shapley
FROM r
"""
