import pytest
from pyspark.sql import functions as F

from semweave.functions.binning import distance_bin
from semweave.functions.stats import exact_quantiles
from semweave.operators import distance as D
from semweave.operators.knn import knn_join
from semweave.sources import tables as TB
from tests.conftest import SF001


def test_bin_edges(spark):
    step = 1.2 / 120
    vals = [0.0, 1 * step, 35 * step, 117 * step, 119 * step, 1.2, 1.2 + 1e-12, -1e-12, 0.35]
    df = spark.createDataFrame([(x,) for x in vals], "d double")
    got = [r[0] for r in df.select(distance_bin("d")).collect()]
    # 0.35 lies just below the literal edge 35 * step, as in numpy's histogram
    assert got == [0, 1, 35, 117, 119, 119, None, None, 34]


def _knn_from(spark, dists):
    return spark.createDataFrame([(0, i + 1, 1, float(d)) for i, d in enumerate(dists)],
                                 "src long, dst long, rank int, dist double")


def test_tau_rules(spark):
    empty = _knn_from(spark, []).filter("false")
    h = D.distance_histogram(empty)
    assert h.count() == 120 and h.agg(F.sum("count")).first()[0] == 0
    assert D.choose_tau(h, 0.2) == pytest.approx(1.2)
    h2 = D.distance_histogram(_knn_from(spark, [0.5, 0.6, 0.7]))
    assert D.choose_tau(h2, 0.0) == pytest.approx(0.01)
    assert D.choose_tau(h2, 0.34) == pytest.approx(0.61)
    taus = [r["tau"] for r in D.tau_candidates(h2, [0.1, 0.5, 0.9]).orderBy("p_keep").collect()]
    assert taus == sorted(taus)


def test_golden_sf0001(spark):
    v = TB.vectors_from_embeddings(TB.load_table(spark, SF001, "embeddings"))
    knn = knn_join(v, 5).cache()
    h = D.distance_histogram(knn)
    assert h.agg(F.sum("count")).first()[0] == 2500
    top = h.orderBy(F.desc("count")).limit(3).collect()
    assert [(r["bin"], r["count"]) for r in top] == [(70, 311), (68, 310), (67, 265)]
    s = D.distance_summary(knn).first()
    assert (round(s["mean"], 6), round(s["median"], 6), round(s["std"], 6)) == (0.67747, 0.684226, 0.039025)
    c = D.distance_summary(knn, mode="chunked").first()
    assert round(c["median"], 6) == round(s["mean"], 6)  # one chunk: median of means = mean
    taus = [round(r["tau"], 3) for r in D.tau_candidates(h).orderBy("p_keep").collect()]
    assert taus == [0.60, 0.63, 0.64, 0.65, 0.66]
    ranks = D.rank_histograms(knn).groupBy("rank").agg(F.sum("count").alias("n")).collect()
    assert sorted((r["rank"], r["n"]) for r in ranks) == [(i, 500) for i in range(1, 6)]


def test_tau_dedup(spark):
    df = spark.createDataFrame([(0.05, 0.61), (0.10, 0.61), (0.15, 0.6300000001)], "p_keep double, tau double")
    out = D.tau_dedup(df).orderBy("p_keep").collect()
    assert [(r["p_keep"], r["tau_tag"]) for r in out] == [(0.05, "tau_0p610"), (0.15, "tau_0p630")]


def test_exact_quantiles_narrowing(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vals = rng.normal(size=5001).round(3)  # many ties
    df = spark.createDataFrame([(float(x),) for x in vals], "x double").repartition(4)
    got = exact_quantiles(df, "x", [0.5, 0.1, 0.9], max_exact=200)
    want = [float(np.percentile(vals, q * 100)) for q in (0.5, 0.1, 0.9)]
    assert got == pytest.approx(want, abs=1e-12)


def test_exact_quantiles_nulls_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,)], "x double")
    assert exact_quantiles(df, "x", [0.5, 0.0, 1.0]) == [2.0, 1.0, 3.0]
    assert exact_quantiles(df.filter("x > 10"), "x", [0.5]) == [None]


def test_chunked_summary_matches_pandas(spark):
    import numpy as np

    v = TB.vectors_from_embeddings(TB.load_table(spark, SF001, "embeddings"))
    knn = knn_join(v, 5).cache()
    got = D.distance_summary(knn, 5, mode="chunked", shard_size=250, chunk=100).first()
    pdf = knn.toPandas()
    pdf["start"] = (pdf.src // 250) * 250 + ((pdf.src % 250) // 100) * 100
    g = pdf.groupby("start").dist
    means, stds = g.mean(), g.std(ddof=0)
    assert len(means) == 6  # chunks restart at each shard: 0,100,200 | 250,350,450
    assert got["mean"] == pytest.approx(means.mean(), abs=1e-12)
    assert got["median"] == pytest.approx(float(np.median(means)), abs=1e-12)
    assert got["std"] == pytest.approx(stds.mean(), abs=1e-12)
    assert (got["min"], got["max"]) == (pdf.dist.min(), pdf.dist.max())
