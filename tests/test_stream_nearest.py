"""The streamed nearest-neighbour join: bytes sent, memory of a task, rows of odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from semweave.operators import cell_index as CI
from semweave.operators import knn as K

VECS = "id long, embedding array<double>"


def _rows(df):
    return sorted((r["src"], r["rank"], r["dst"], round(r["dist"], 9)) for r in df.collect())


def _vectors(spark, n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=dim).tolist()) for i in range(n)], VECS)


def test_exact_join_shuffles_the_vectors_once_and_no_candidates(spark):
    df = K.knn_join(_vectors(spark, 400), 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Window" not in plan


def test_sets_do_not_grow_with_the_table_until_a_task_is_full(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(1)
    assert {K._sets(one, n) for n in (10_000, 100_000, cores * K.SET_ROWS)} == {cores}
    assert K._sets(one, 10 * cores * K.SET_ROWS) == 10 * cores
    # a caller's few sets are cut where a task would hold too many queries
    assert math.ceil(100 * K.SET_ROWS / K._sets(one, 100 * K.SET_ROWS, 7)) <= K.SET_ROWS


def test_a_set_holds_tiles_of_bounded_size(spark, monkeypatch):
    """One block of 3000 rows used to be one group and its matrix 1024 x 3000."""
    monkeypatch.setattr(K, "_STREAM_CHUNK", 50)
    rng = np.random.default_rng(0)
    mat = K.unit(rng.normal(size=(3000, 4)))
    ids = np.arange(3000)
    seen = []
    meet = K._Lists.meet
    monkeypatch.setattr(K._Lists, "meet", lambda self, r, i, m, f: (seen.append(len(i)), meet(self, r, i, m, f))[1])
    import pyarrow as pa

    def batch(role):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, role, np.int32)), pa.array(np.zeros(n, np.int32)),
             pa.array(ids), K.pack(mat), pa.nulls(n, pa.list_(pa.int32()))], ["set", "role", "cell", "id", "vec", "probes"])

    out = pa.Table.from_batches(list(K._stream_kernel(3)(iter([batch(0), batch(1)]))))
    assert max(seen) == 50 and out.num_rows == 9000
    d = K._distance(mat[:20] @ mat.T)
    d[np.arange(20), np.arange(20)] = np.inf
    got = out.to_pandas().sort_values(["src", "rank"])
    assert got[got["src"] < 20]["dst"].tolist() == np.argsort(d, axis=1, kind="stable")[:, :3].ravel().tolist()


def test_odd_rows(spark):
    """Repeated ids, many equal vectors, no numbers, zero vectors: rows do not depend on the number of sets."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(90)]
    rows += [(100 + i, [1.0, 2.0, 3.0]) for i in range(60)] + [(200, [0.0, 0.0, 0.0]), (201, [float("nan"), 1.0, 2.0])]
    rows += rows[5:8]
    v = spark.createDataFrame(rows, VECS)
    want = _rows(K.knn_join(v, 7, num_blocks=1))
    assert _rows(K.knn_join(v, 7, num_blocks=4)) == want
    assert {r[0] for r in want} == {i for i, _ in rows} - {201}
    assert [r[2] for r in want if r[0] == 130] == list(range(100, 107))
    assert [r[2:] for r in want if r[0] == 5][0] == (5, 0.0)  # the other row of the id


@pytest.mark.parametrize("nprobe", [6, 9, 1_000_000])
def test_many_probes_send_a_query_once(spark, monkeypatch, nprobe):
    """More cells than sets: the rows of the old way, without a copy of a query for every cell it probes."""
    v = _vectors(spark, 300)
    monkeypatch.setattr(K, "_sets", lambda *a, **kw: 2)
    calls = []
    bucketed = K._bucketed_candidates
    monkeypatch.setattr(K, "_bucketed_candidates", lambda *a, **kw: calls.append(1) or bucketed(*a, **kw))
    got = _rows(K.knn_join(v, 5, mode="ivf", n_cells=9, nprobe=nprobe))
    assert not calls
    monkeypatch.setattr(K, "_sets", lambda *a, **kw: 100)
    if nprobe < 9:
        assert got == _rows(K.knn_join(v, 5, mode="ivf", n_cells=9, nprobe=nprobe)) and calls
    else:
        assert got == _rows(K.knn_join(v, 5))


def test_index_names_the_cells_of_a_query_in_one_row(spark, tmp_path):
    """A query that wants many cells was a row with its vector for each of them, made by one batch."""
    v = _vectors(spark, 300)
    path = str(tmp_path / "index")
    CI.build_index(v, path, n_cells=20)
    vectors, cells = CI.open_index(spark, path)
    q = CI.query_vectors(vectors, spark.range(50)).select("id", "vec", F.lit(math.pi).alias("reach"),
                                                          F.array().cast("array<int>").alias("done"))
    wanted = CI._wanted(q, cells, None)
    assert wanted.count() == 50
    assert wanted.select(F.size("probes").alias("n")).distinct().collect()[0]["n"] == cells.count()
    assert _rows(CI.index_lookup(spark, path, spark.range(50), 5)) == _rows(K.knn_lookup(v, spark.range(50), 5))
