import pytest
from pyspark.sql import functions as F

from semweave.operators.recommend import check_ids, pick_random, recommend
from semweave.sources import tables as TB


def test_significance_semantics(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.8, 0.3]), (3, [0.0, 1.0])],
                              "id long, embedding array<float>")
    papers = spark.createDataFrame([(0, 2020, "t0"), (1, 2021, "t1\tx"), (2, 2022, None), (3, 2023, "t3")],
                                   "paper_id long, year int, title string")
    part = spark.createDataFrame([(0, 7), (1, 7), (2, 8)], "node long, community long")
    q = spark.createDataFrame([(0,), (3,)], "id long")
    rows = recommend(q, v, papers, part, k=2).orderBy("query_id", "rank").collect()
    r0 = [(r.id, r.in_partition, r.same_community, r.significance) for r in rows if r.query_id == 0]
    assert r0 == [(1, True, True, "significant"), (2, True, False, "non-significant")]
    r3 = [r for r in rows if r.query_id == 3]
    assert all(not r.same_community for r in r3)  # query outside the partition
    assert rows[0].title == "t1 x"
    none = recommend(q, v, papers, None, k=1).collect()
    assert all(r.significance == "non-significant" and not r.in_partition for r in none)


def test_check_ids_and_pick(spark):
    nodes = spark.range(5).select(F.col("id").alias("node"))
    check_ids(spark.createDataFrame([(1,), (4,)], "id long"), nodes)
    with pytest.raises(ValueError):
        check_ids(spark.createDataFrame([(9,)], "id long"), nodes)
    a = pick_random(nodes, 42).first()["id"]
    assert a == pick_random(nodes, 42).first()["id"]


def test_unknown_metadata_placeholder(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (7, [0.8, 0.3])], "id long, embedding array<float>")
    papers = spark.createDataFrame([(0, 2020, "t0"), (1, 2021, None)], "paper_id long, year int, title string")
    rows = recommend(spark.createDataFrame([(0,)], "id long"), v, papers, None, k=2).orderBy("rank").collect()
    assert [(r.id, r.title, r.year) for r in rows] == [(1, "", 2021), (7, "<unknown 7>", None)]


def test_fp16_rounding(spark):
    import numpy as np

    from semweave.operators.embed import fp16_round

    df = spark.createDataFrame([(0, [0.1, 1.0 / 3.0])], "id long, embedding array<float>")
    got = fp16_round(df).first()["embedding"]
    want = np.asarray([0.1, 1.0 / 3.0], dtype=np.float16).astype(np.float32).tolist()
    assert got == pytest.approx(want, abs=0)
