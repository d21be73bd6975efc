"""Stored inverted file: exact rows, only the needed cells are read; appending to a kNN table."""

import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from semweave.operators.cell_index import build_index, cells_read, index_lookup, open_index
from semweave.operators.knn import knn_append, knn_join, knn_lookup
from semweave.session import materialize

VECS = "id long, embedding array<double>"


def rows_of(df):
    return sorted((r["src"], r["rank"], r["dst"], round(r["dist"], 9)) for r in df.collect())


def _clusters(spark, per=60, seed=2):
    rng = np.random.default_rng(seed)
    centres = np.eye(8) * 10
    return spark.createDataFrame([(i, (centres[i % 8] + rng.normal(size=8)).tolist()) for i in range(8 * per)], VECS)


def test_only_needed_cells_are_read(spark, tmp_path):
    v = _clusters(spark)
    path = str(tmp_path / "index")
    build_index(v, path, n_cells=8)
    queries = spark.createDataFrame([(i,) for i in range(0, 400, 8)], "id long")  # of one cluster
    want = rows_of(knn_lookup(v, queries, 5))
    assert rows_of(index_lookup(spark, path, queries, 5)) == want
    home = {r["cell"] for r in open_index(spark, path)[0].where(F.col("id") % 8 == 0).select("cell").distinct().collect()}
    for r in open_index(spark, path)[1].collect():  # cells out of reach may as well be missing
        if r["cell"] not in home:
            shutil.rmtree(f"{path}/vectors/cell={r['cell']}")
    assert rows_of(index_lookup(spark, path, queries, 5)) == want


def test_partitions_are_pruned_at_run_time(spark, tmp_path):
    path = str(tmp_path / "index")
    build_index(_clusters(spark), path, n_cells=8)
    cells = open_index(spark, path)[1]
    one = cells.where("cell = 3").first()
    wanted = materialize(cells.where(F.col("radius") == one["radius"]).select("cell"), "wanted")
    df = cells_read(spark, path, wanted)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert {r["cell"] for r in df.select("cell").distinct().collect()} == {3}


def test_rows_equal_the_scan_on_odd_vectors(spark, tmp_path):
    """Copies, opposite and zero vectors, near ties, an unknown and a null id, fewer vectors than k."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)]
    rows += [(1000 + i, [1.0, 2.0, 3.0]) for i in range(120)]  # a third are one vector
    rows += [(2000 + i, [0.0, 0.0, 0.0]) for i in range(3)] + [(3000, [-1.0, -2.0, -3.0]), (3001, [1.0, 2.0, 3.0 + 1e-6])]
    v = spark.createDataFrame(rows, VECS)
    queries = spark.createDataFrame([(0,), (5,), (1000,), (1077,), (2001,), (3000,), (3001,), (9999,), (None,)], "id long")
    path = str(tmp_path / "index")
    for cells in (1, 9):
        build_index(v, path, n_cells=cells)
        for k in (3, 150):
            assert rows_of(index_lookup(spark, path, queries, k)) == rows_of(knn_lookup(v, queries, k))
    few = v.where("id < 4")
    build_index(few, path)
    assert rows_of(index_lookup(spark, path, queries, 5)) == rows_of(knn_lookup(few, queries, 5))
    assert math.isclose(open_index(spark, path)[1].agg(F.sum("n")).first()[0], 4)
    assert index_lookup(spark, path, queries.where("false"), 5).count() == 0


def test_two_appends_equal_a_rebuild_and_measure_no_old_pairs(spark):
    from semweave.operators import knn as K

    v = _clusters(spark, per=40, seed=5)
    part = [v.where(F.pmod("id", F.lit(4)).isin(i)) for i in ([0, 1], [2], [3])]
    nn = knn_join(part[0], 6, block_rows=50)
    old = part[0]
    kernel = K._cross_kernel

    def checked(k):
        run = kernel(k)

        def inner(tbl):
            mod = {r: {i % 4 for i, x in zip(tbl.column("id").to_pylist(), tbl.column("role").to_pylist(), strict=True) if x == r}
                   for r in (0, 1)}
            assert len(mod[1]) == 1 and not mod[0] & mod[1]  # one side is always the new rows
            return run(tbl)

        return inner

    K._cross_kernel = checked
    try:
        for new in part[1:]:
            nn = knn_append(nn, old, new, 6, block_rows=50)
            old = old.unionByName(new)
        got = rows_of(nn)
    finally:
        K._cross_kernel = kernel
    assert got == rows_of(knn_join(v, 6))
    with pytest.raises(ValueError):
        knn_append(nn, v, part[2], 6)
    assert rows_of(knn_append(nn, v, v.where("false"), 6)) == got
