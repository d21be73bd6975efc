"""Neighbour descent: recall against the share of pairs, hubs, copies, small and empty inputs."""

import numpy as np
import pytest

from semweave.operators.knn import knn_join, knn_recall
from semweave.operators.nn_descent import nn_descent
from semweave.sources import tables as TB

SF = "/root/testdata/sf0.1"
VECS = "id long, embedding array<double>"


def test_recall_of_090_with_under_30_percent_of_the_pairs(spark):
    v = TB.vectors_from_embeddings(TB.load_table(spark, SF, "embeddings"))
    n = v.count()
    nn, rounds = nn_descent(v, 5, max_rounds=5)
    log = rounds.orderBy("round").collect()
    assert knn_recall(nn, knn_join(v, 5), 5).first()["recall"] >= 0.9
    assert sum(r["pairs"] for r in log) < 0.3 * n * (n - 1) / 2
    updates = [r["updates"] for r in log[1:]]
    assert updates == sorted(updates, reverse=True)  # it settles


def test_clustered_vectors_with_a_hub_and_copies(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [(i, [1.0] * 8) for i in range(900, 1200)]  # a quarter of the rows are one vector
    v = spark.createDataFrame(rows, VECS)
    nn, rounds = nn_descent(v, 4, pool=16, reverse=16, budget=20, tables=3, max_rounds=12, delta=0.001)
    got, want = nn.collect(), {(r["src"], r["rank"]): r["dist"] for r in knn_join(v, 4).collect()}
    assert len(got) == 4 * len(rows) and not any(r["src"] == r["dst"] for r in got)
    assert len({(r["src"], r["dst"]) for r in got}) == len(got)
    # copies tie, so distances are compared
    assert np.mean([r["dist"] <= want[r["src"], r["rank"]] + 1e-9 for r in got]) > 0.95


@pytest.mark.parametrize("n", [1, 2, 7])
def test_few_vectors_are_exact(spark, n):
    rows = [(10 * i, [float(i), 1.0, -float(i % 3)]) for i in range(n)]
    v = spark.createDataFrame(rows, VECS)
    key = lambda df: sorted((r["src"], r["dst"], round(r["dist"], 9)) for r in df.collect())
    assert key(nn_descent(v, 3, seed=1, max_rounds=30, delta=0.0)[0]) == key(knn_join(v, 3))


def test_empty(spark):
    nn, rounds = nn_descent(spark.createDataFrame([], VECS), 3)
    assert nn.count() == 0 and rounds.count() == 0


def _vectors(spark, n, dim=8, seed=5):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return spark.createDataFrame([(3 * i - 100, r.tolist()) for i, r in enumerate(m)], VECS)


def test_lists_are_sent_once_per_set(spark):
    def sent():
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    v = _vectors(spark, 4000)
    before = sent()
    nn, rounds = nn_descent(v, 4, max_rounds=3, delta=0.0)
    assert rounds.count() == 4
    # bytes a vector; 59,210 when every block of vectors got the lists of all neighbours
    assert (sent() - before) / 4000 < 40_000
    assert nn.count() == 16_000


def test_rows_do_not_depend_on_sets_blocks_and_chunks(spark, monkeypatch):
    from semweave.operators import nn_descent as D

    v = _vectors(spark, 700)
    rows = lambda df: sorted(map(tuple, df.collect()))
    args = dict(pool=12, reverse=10, budget=8, tables=2, block=16, max_rounds=3, delta=0.0)
    nn, rounds = nn_descent(v, 4, **args)
    want = rows(nn), rows(rounds)
    for name, value in (("SET_ROWS", 60), ("BLOCK_ROWS", 25), ("CHUNK", 1500)):
        monkeypatch.setattr(D, name, value)
    lay = D._Layout(700, 4, 22)
    assert lay.sets == 12 and lay.blocks > lay.sets and lay.chunks > 8
    nn, rounds = nn_descent(v, 4, **args)
    assert (rows(nn), rows(rounds)) == want


def test_a_vector_proposes_the_best_it_has_not_met():
    import pyarrow as pa

    from semweave.operators import nn_descent as D

    rng = np.random.default_rng(2)
    n, budget, lay = 90, 5, D._Layout(90, 1, 8)
    sim = np.where(rng.random((n, n)) < 0.08, rng.random((n, n)), 0).astype(np.float32)
    np.fill_diagonal(sim, 0)
    met = (rng.random((n, n)) < 0.3) | (sim > 0)
    a, b = np.nonzero(sim)
    counts = np.bincount(a, minlength=lay.rows).astype(lay.count).tobytes()
    join = D._Join(lay, 0, budget, [(0, pa.py_buffer(counts + lay.place(b).astype(lay.kind).tobytes() + sim[a, b].tobytes()))])
    known = np.empty(int(met.sum()), D._MET)
    known["p"], known["y"] = np.nonzero(met)
    join.meet(0, [(0, pa.py_buffer(counts + b.astype(np.uint16).tobytes() + sim[a, b].tobytes()))], [known])
    score = sim.astype(float) @ sim.astype(float)
    score[met | np.eye(n, dtype=bool)] = 0
    best = [(i, int(j)) for i in range(n) for j in np.lexsort((np.arange(n), -score[i]))[:budget] if score[i, j] > 0]
    got = [np.concatenate(x) for x in zip(*join.proposed(), strict=True)]
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(best)
