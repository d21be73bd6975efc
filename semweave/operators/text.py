"""Exploratory statistics over the cleaned paper table.

Input: ``papers(paper_id, year, n_words, ...)`` as produced by
:func:`semweave.sources.papers.clean_papers`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paper_stats(papers: DataFrame) -> DataFrame:
    """``(paper_id, year, n_words)`` — the two EDA vectors as columns."""
    return papers.select("paper_id", "year", "n_words")


def eda_stats(papers: DataFrame) -> DataFrame:
    """One-row summary: totals, year range, length mean/median/min/max and
    the short-text counts and percentages (< 5 and < 10 words).

    The exact median is over integer word counts; its aggregation buffer
    is a map keyed by distinct count, bounded by the longest text, not by
    the number of papers.
    """
    n = F.count(F.lit(1))
    out = papers.agg(
        n.alias("total_papers"),
        F.min("year").cast("int").alias("year_min"),
        F.max("year").cast("int").alias("year_max"),
        F.avg("n_words").alias("len_mean"),
        F.percentile("n_words", 0.5).cast("double").alias("len_median"),
        F.min("n_words").cast("int").alias("len_min"),
        F.max("n_words").cast("int").alias("len_max"),
        F.count_if(F.col("n_words") < 5).alias("short_5"),
        F.count_if(F.col("n_words") < 10).alias("short_10"),
    )
    return (out.withColumn("short_5_pct", F.lit(100.0) * F.col("short_5") / F.col("total_papers"))
            .withColumn("short_10_pct", F.lit(100.0) * F.col("short_10") / F.col("total_papers"))
            .select("total_papers", "year_min", "year_max", "len_mean", "len_median", "len_min",
                    "len_max", "short_5", "short_5_pct", "short_10", "short_10_pct"))


def year_distribution(papers: DataFrame) -> DataFrame:
    """Papers per year ``(year, papers)``, sorted by year."""
    return (papers.groupBy("year").agg(F.count(F.lit(1)).alias("papers")).orderBy("year"))


def short_text_share(papers: DataFrame) -> DataFrame:
    """Per-year short-text counts and shares ``(year, papers, short_5, short_5_pct, short_10, short_10_pct)``."""
    g = papers.groupBy("year").agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_if(F.col("n_words") < 5).alias("short_5"),
        F.count_if(F.col("n_words") < 10).alias("short_10"))
    return (g.withColumn("short_5_pct", F.lit(100.0) * F.col("short_5") / F.col("papers"))
            .withColumn("short_10_pct", F.lit(100.0) * F.col("short_10") / F.col("papers"))
            .select("year", "papers", "short_5", "short_5_pct", "short_10", "short_10_pct"))


def length_histogram(papers: DataFrame, bins: int = 50, col: str = "n_words") -> DataFrame:
    """Equal-width histogram of ``col`` over ``[min, max]``.

    Edges are ``min + i * (max - min) / bins`` with the last edge exactly
    ``max``; intervals are half open except the last. When ``min == max``
    the range is widened by 0.5 on both sides. Output
    ``(bin, lo, hi, count)`` includes empty bins.

    The texts are scanned once: counts per distinct value (a partial
    aggregation whose output is bounded by the number of distinct lengths)
    are materialised, and the range and the binning run on that small table.
    """
    from semweave.session import materialize

    by_value = materialize(papers.groupBy(F.col(col).cast("double").alias("x"))
                           .agg(F.count(F.lit(1)).alias("c")), "lengths")
    x = F.col("x")
    r = by_value.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).first()  # two scalars
    if r["mn"] is None:
        raise RuntimeError("length_histogram: no rows")
    first, last = float(r["mn"]), float(r["mx"])
    if first == last:
        first, last = first - 0.5, last + 0.5
    step = (last - first) / bins
    scale = bins / (last - first)

    def edge(i):
        return F.when(i >= F.lit(bins), F.lit(last)).otherwise(i.cast("double") * F.lit(step) + F.lit(first))

    spark = papers.sparkSession
    grid = (spark.range(bins).select(F.col("id").cast("int").alias("bin"))
            .select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi")))
    g = F.floor((x - F.lit(first)) * F.lit(scale))
    g = F.least(F.greatest(g.cast("int"), F.lit(0)), F.lit(bins - 1))
    fixed = (F.when(x < edge(g), g - 1)
             .when((x >= edge(g + 1)) & (g != F.lit(bins - 1)), g + 1)
             .otherwise(g))
    counts = by_value.select(fixed.alias("bin"), "c").groupBy("bin").agg(F.sum("c").alias("count"))
    # counts has at most `bins` rows: a bounded broadcast
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("long").alias("count")))
