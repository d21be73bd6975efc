"""Hot keys: a third of the rows sharing one value must neither blow up
the output nor change the result."""

import numpy as np
from pyspark.sql import functions as F

from semweave.operators.knn import knn_join, knn_recall
from semweave.operators.louvain import louvain
from semweave.sources import tables as TB


def _skewed_vectors(spark, n=90, hot=30, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dim)
    rows = []
    for i in range(n):
        v = base if i % 3 == 0 and len([r for r in rows if r[2]]) < hot else rng.normal(size=dim)
        rows.append((i, [float(x) for x in v], bool(np.array_equal(v, base))))
    return spark.createDataFrame([(i, v) for i, v, _ in rows], "id long, embedding array<float>"), \
        sorted(i for i, _, h in rows if h)


def test_identical_vectors_tie_break_by_id(spark):
    df, hot = _skewed_vectors(spark)
    k = 4
    for blocks in (1, 4):
        knn = knn_join(df, k, num_blocks=blocks)
        assert knn.count() == 90 * k  # no tie explosion
        for src in hot[:5]:
            got = [r.dst for r in knn.filter(F.col("src") == src).orderBy("rank").collect()]
            assert got == [h for h in hot if h != src][:k]
            assert all(r.dist == 0.0 for r in knn.filter(F.col("src") == src).collect())


def test_hot_ivf_cell_is_split_and_exact_at_full_probe(spark):
    df, _ = _skewed_vectors(spark)
    exact = knn_join(df, 4)
    ivf = knn_join(df, 4, mode="ivf", n_cells=3, nprobe=3, block_rows=8)  # hot cell -> many sub-blocks
    assert knn_recall(ivf, exact, 4).first()["recall"] == 1.0


def test_duplicate_star_with_hot_text(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(300)],
                                 "doc_id long, text string")
    e = TB.duplicate_edges(docs)
    assert e.count() == 99  # 100 copies -> 99 star edges, not 4950 pairs
    assert e.select("src").distinct().collect()[0][0] == 0
    part, summ = louvain(e, docs.select(F.col("doc_id").alias("node")))
    assert part.filter("community = 0").count() == 100
    assert summ.first()["num_communities"] == 201
