"""Distributions of kNN distances and the threshold chosen from them.

All inputs are ``knn(src, dst, rank, dist)`` tables. The histogram uses
the first ``max_rank`` neighbours (5 by default, i.e. the reference's
six-nearest query without self).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semweave.functions.binning import HIST_BINS, HIST_HI, bin_edge, distance_bin
from semweave.functions.stats import exact_quantiles

# Default percentile candidates of the threshold sweep.
DEFAULT_PKEEP = (0.05, 0.10, 0.15, 0.20, 0.25)


def _bins_frame(spark, bins: int = HIST_BINS, hi: float = HIST_HI) -> DataFrame:
    """``(bin, lo, hi, center)`` for every bin; 120 rows, generated."""
    b = F.col("id").cast("int")
    return (spark.range(bins).select(b.alias("bin"))
            .withColumn("lo", bin_edge(F.col("bin"), hi, bins))
            .withColumn("hi", bin_edge(F.col("bin") + 1, hi, bins))
            .withColumn("center", F.lit(0.5) * (F.col("hi") + F.col("lo"))))


def _ranked(knn: DataFrame, max_rank: int) -> DataFrame:
    return knn.filter(F.col("rank") <= F.lit(max_rank))


def distance_histogram(knn: DataFrame, max_rank: int = 5, bins: int = HIST_BINS,
                       hi: float = HIST_HI) -> DataFrame:
    """Global histogram ``(bin, lo, hi, center, count)`` with empty bins as 0.

    Distances outside ``[0, hi]`` are not counted. The aggregation is
    partial per partition, so only ``bins`` rows per task are shuffled.
    """
    counts = (_ranked(knn, max_rank)
              .select(distance_bin(F.col("dist"), hi, bins).alias("bin"))
              .filter(F.col("bin").isNotNull())
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = _bins_frame(knn.sparkSession, bins, hi)
    # counts has at most `bins` rows: a bounded broadcast
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", "lo", "hi", "center",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def rank_histograms(knn: DataFrame, max_rank: int = 5, bins: int = HIST_BINS,
                    hi: float = HIST_HI) -> DataFrame:
    """One histogram per neighbour rank ``1..max_rank`` (always all ranks)."""
    counts = (_ranked(knn, max_rank)
              .select("rank", distance_bin(F.col("dist"), hi, bins).alias("bin"))
              .filter(F.col("bin").isNotNull())
              .groupBy("rank", "bin").agg(F.count(F.lit(1)).alias("count")))
    spark = knn.sparkSession
    cell = spark.range(max_rank * bins)
    grid = (cell.select((F.floor(F.col("id") / F.lit(bins)) + 1).cast("int").alias("rank"),
                        F.pmod(F.col("id"), F.lit(bins)).cast("int").alias("bin"))
            .withColumn("lo", bin_edge(F.col("bin"), hi, bins))
            .withColumn("hi", bin_edge(F.col("bin") + 1, hi, bins))
            .withColumn("center", F.lit(0.5) * (F.col("hi") + F.col("lo"))))
    # counts has at most `max_rank * bins` rows: a bounded broadcast
    return (grid.join(F.broadcast(counts), ["rank", "bin"], "left")
            .select("rank", "bin", "lo", "hi", "center",
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def distance_cdf(hist: DataFrame) -> DataFrame:
    """Adds ``cum_count`` and ``cdf = cumsum / max(total, 1)``.

    The histogram has a fixed, small number of rows, so the un-partitioned
    running window is bounded.
    """
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return (hist.withColumn("cum_count", F.sum("count").over(w))
            .withColumn("cdf", F.col("cum_count") / F.greatest(total, F.lit(1)).cast("double")))


def tau_candidates(hist: DataFrame, pkeep=DEFAULT_PKEEP, bins: int = HIST_BINS,
                   hi: float = HIST_HI) -> DataFrame:
    """``(p_keep, tau)``: τ = upper edge of the first bin whose cdf ≥ p.

    If no bin qualifies (e.g. an empty histogram) τ is the last edge.
    One aggregate over the histogram computes every candidate at once.
    """
    cdf = distance_cdf(hist)
    firsts = [F.min(F.when(F.col("cdf") >= F.lit(float(p)), F.col("bin"))).alias(f"b{i}")
              for i, p in enumerate(pkeep)]
    row = cdf.agg(*firsts)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p_keep"), F.col(f"b{i}").alias("first_bin"))
                      for i, p in enumerate(pkeep)])
    out = row.select(F.inline(pairs))
    idx = F.least(F.coalesce(F.col("first_bin"), F.lit(bins)) + 1, F.lit(bins))
    return out.select("p_keep", bin_edge(idx, hi, bins).alias("tau"))


def choose_tau(hist: DataFrame, pkeep: float) -> float:
    """The scalar τ for one percentile (a one-row action)."""
    return float(tau_candidates(hist, [pkeep]).first()["tau"])


def tau_dedup(taus: DataFrame) -> DataFrame:
    """Keep the first ``p_keep`` of each τ rounded to 3 places; adds ``tau_tag``."""
    from semweave.functions.text import tau_tag

    w = Window.partitionBy(F.round("tau", 3)).orderBy("p_keep")
    return (taus.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
            .withColumn("tau_tag", tau_tag(F.col("tau"))))


def distance_chunk_stats(knn: DataFrame, max_rank: int = 5, shard_size: int = 25_000,
                         chunk: int = 20_000) -> DataFrame:
    """Per-chunk ``mean, median, std (population), min, max`` of distances.

    Chunks follow the reference's reading order: ``chunk`` consecutive ids,
    restarting at each shard of ``shard_size`` ids. A chunk holds at most
    ``chunk * max_rank`` values, so its exact median is bounded.
    """
    ck = (F.floor(F.col("src") / F.lit(shard_size)) * F.lit(shard_size)
          + F.floor(F.pmod(F.col("src"), F.lit(shard_size)) / F.lit(chunk)) * F.lit(chunk))
    return (_ranked(knn, max_rank).withColumn("start", ck.cast("long"))
            .groupBy("start")
            .agg(F.avg("dist").alias("mean"),
                 F.percentile("dist", 0.5).alias("median"),
                 F.stddev_pop("dist").alias("std"),
                 F.min("dist").alias("min"),
                 F.max("dist").alias("max")))


def distance_summary(knn: DataFrame, max_rank: int = 5, mode: str = "exact",
                     shard_size: int = 25_000, chunk: int = 20_000) -> DataFrame:
    """One row ``(mean, median, std, min, max)`` of the neighbour distances.

    ``mode="exact"``: statistics of all distances; the median is exact and
    computed without gathering the column in one task.
    ``mode="chunked"``: the reference's two-level summary — mean of chunk
    means, median of chunk means, mean of chunk std, min, max.
    """
    if mode == "chunked":
        cs = distance_chunk_stats(knn, max_rank, shard_size, chunk)
        return cs.agg(F.avg("mean").alias("mean"), F.percentile("mean", 0.5).alias("median"),
                      F.avg("std").alias("std"), F.min("min").alias("min"),
                      F.max("max").alias("max"))
    if mode != "exact":
        raise ValueError(mode)
    d = _ranked(knn, max_rank).select("dist")
    (med,) = exact_quantiles(d, "dist", [0.5])
    return d.agg(F.avg("dist").alias("mean"),
                 F.lit(med).cast("double").alias("median"),
                 F.stddev_pop("dist").alias("std"),
                 F.min("dist").alias("min"),
                 F.max("dist").alias("max"))
