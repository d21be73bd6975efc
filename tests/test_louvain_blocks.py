"""Louvain in blocks: the same quality for any block size, hubs outside the blocks, arcs that stay where they lie."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semweave.operators import community as C
from semweave.operators import louvain as L
from semweave.operators.local_moves import move_kernel
from semweave.session import bucket_labels, materialize_bucketed


def _planted(groups=12, size=25, inside=5, outside=1, seed=3):
    rnd, edges = random.Random(seed), set()
    for u in range(groups * size):
        for _ in range(inside):
            v = u // size * size + rnd.randrange(size)
            edges.add((min(u, v), max(u, v)))
        for _ in range(outside):
            v = rnd.randrange(groups * size)
            edges.add((min(u, v), max(u, v)))
    return [(u, v, 1.0) for u, v in sorted(edges) if u != v]


EDGES = "src long, dst long, weight double"


@pytest.mark.parametrize("kw", [{}, {"block_arcs": 300}, {"block_arcs": 300, "hub_arcs": 14}, {"block_arcs": 60, "hub_arcs": 1}])
def test_blocks_and_hubs_find_the_planted_groups(spark, kw):
    e = spark.createDataFrame(_planted(), EDGES)
    p, s = L.louvain(e, **kw)
    row = s.first()
    truth = p.select("node", F.floor(F.col("node") / 25).cast("long").alias("community"))
    assert row["modularity"] == pytest.approx(C.modularity(e, p).first()["modularity"], abs=1e-9)
    assert row["modularity"] >= C.modularity(e, truth).first()["modularity"] - 0.02
    assert row["converged"] and p.count() == 300


def test_a_hub_is_moved_by_aggregates(spark):
    """A star whose centre has more arcs than a block holds, beside a clique."""
    rows = [(0, i, 1.0) for i in range(1, 200)] + [(1000 + i, 1000 + j, 1.0) for i in range(6) for j in range(i + 1, 6)]
    e = spark.createDataFrame(rows, EDGES)
    p, s = L.louvain(e, block_arcs=40)
    got = {r["node"]: r["community"] for r in p.collect()}
    assert {got[i] for i in range(200)} == {0} and {got[1000 + i] for i in range(6)} == {1000}
    assert s.first()["modularity"] == pytest.approx(C.modularity(e, p).first()["modularity"], abs=1e-9)


def test_arcs_are_not_shuffled_in_a_round(spark):
    rows = [(b, 0, u, v, 1.0, 1.0) for b in range(8) for u, v in ((b, b + 1), (b + 1, b))]
    arcs = materialize_bucketed(spark.createDataFrame(rows, "blk long, g long, u long, v long, w double, k double"), "blk", "arcs")
    state = spark.createDataFrame([(0, n, n, n, n, 2.0, n % 8) for n in range(9)],
                                  "g long, node long, comm long, prev long, best long, k double, blk long")
    copies = spark.createDataFrame([(b, 0, b + 1) for b in range(8)], "blk long, g long, node long")
    out = L._block_round(state, arcs, copies, {0: 8.0}, [0], [], 0, 0, 0, 42)
    plan = out._jdf.queryExecution().executedPlan().toString()
    arcs_side = plan[plan.index("FlatMapCoGroupsInArrow"):]
    arcs_side = arcs_side[:arcs_side.index("Bucketed: true")]
    assert "Exchange" not in arcs_side
    assert out.count() == 9


def test_kernel_moves_one_after_another():
    """Two triangles with a bridge: one call finds both, whatever the order of the rows."""
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    both = pairs + [(b, a) for a, b in pairs]
    random.Random(1).shuffle(both)
    k = np.bincount(np.array(pairs).ravel(), minlength=6).astype(float)
    arcs = pa.table({"g": [0] * 14, "u": [a for a, _ in both], "v": [b for _, b in both], "w": [1.0] * 14})
    ids = list(range(6))
    nodes = pa.table({"g": [0] * 6, "node": ids, "comm": ids, "prev": ids, "best": ids, "k": k, "blk": [0] * 6,
                      "tot": k, "size": [1] * 6, "own": [True] * 6})
    out = move_kernel({0: 7.0}, [], 0, 9, True)(arcs, nodes)
    got = dict(zip(out.column("node").to_pylist(), out.column("comm").to_pylist(), strict=True))
    assert len({got[0], got[1], got[2]}) == 1 and len({got[3], got[4], got[5]}) == 1 and got[0] != got[5]
    assert sum(out.column("own_w").to_pylist()) == 0 and sum(out.column("own_t").to_pylist()) == float((k * k).sum())


def test_few_blocks_are_few_tasks_and_no_table_is_broadcast(spark, monkeypatch):
    """A round of one block was a task for every shuffle partition, and tables of the graph's size went through the driver."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        made, plans = [], []
        bucketed, block_round = L.materialize_bucketed, L._block_round

        def kept(*args):
            made.append(bucketed(*args))
            return made[-1]

        def planned(*args):
            out = block_round(*args)
            plans.append((made[-1].rdd.getNumPartitions(), out._jdf.queryExecution().executedPlan().toString()))
            return out

        monkeypatch.setattr(L, "materialize_bucketed", kept)
        monkeypatch.setattr(L, "_block_round", planned)
        ring = spark.range(60).select(F.col("id").alias("src"), ((F.col("id") + 1) % 60).alias("dst"), F.lit(1.0).alias("weight"))
        one = L.louvain(ring, seed=1)[1].first()
        assert max(n for n, _ in plans) <= 8
        assert not any("Broadcast" in p for _, p in plans)
        several = L.louvain(ring, seed=1, block_arcs=30)[1].first()
        assert not any("Broadcast" in p for _, p in plans)
        assert one["modularity"] > 0.7 and several["modularity"] > 0.7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rounds_send_the_driver_no_aggregates_for_every_graph(spark, monkeypatch):
    """Sums observed during a write came back from every task with their expressions, three for every graph."""
    observed, write = [], L.materialize

    def counted(df, tag="t", observe=None, drop=()):
        observed.append(len(observe or {}))
        return write(df, tag, observe=observe, drop=drop)

    monkeypatch.setattr(L, "materialize", counted)
    rows = [(f"g{i}", *e) for i in range(5) for e in _planted(groups=2 + i, size=8, inside=3)]
    e = spark.createDataFrame(rows, "graph string, " + EDGES)
    p, s = L.louvain(e, graph_col="graph", max_rounds=2, max_levels=1)
    assert max(observed) <= 1
    want = {r["graph"]: r["modularity"] for r in C.modularity_by_graph(e, p, "graph").collect()}
    got = {r["graph"]: r["modularity"] for r in s.collect()}
    assert len(got) == 5 and got == pytest.approx(want, abs=1e-9)


def test_every_block_has_a_bucket_of_its_own(spark):
    """Four buckets were made for a block, and each was a task of every round."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for keys in (3, 12, 40):
            labels = bucket_labels(spark, keys)
            assert len(set(labels)) == keys - 1 and min(labels) >= 0
            rows = spark.createDataFrame([(x,) for x in [-1, *labels]], "blk long")
            t = materialize_bucketed(rows, "blk", "labels", keys)
            assert t.select(F.input_file_name()).distinct().count() == keys  # a file a bucket
        assert bucket_labels(spark, 65) == list(range(64)) and bucket_labels(spark, 2) == [0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
