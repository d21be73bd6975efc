"""Embedding whitening: rank-one updates, exact columns and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semweave.llm import whitening
from tests.conftest import SF01

VECS = "vec_id long, embedding array<float>"


def scatter(y):
    c = y - y.mean(0)
    return c.T @ c


@pytest.mark.parametrize("shape", ["plain", "equal rows", "constant dimensions", "repeated rows", "axes"])
@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_spectrum_equals_eigh_of_the_scatter(d, shape):
    rng = np.random.default_rng(d)
    y = np.round(rng.normal(size=(120, d)) * rng.uniform(0.1, 300, size=d))
    if shape == "equal rows":
        y[:] = y[0]
    elif shape == "constant dimensions":
        y[:, d // 2:] = 3
    elif shape == "repeated rows":
        y[60:] = y[:60]
    elif shape == "axes":
        y = np.eye(d)[rng.integers(0, d, 120)] * 9
    s = whitening.Spectrum(d)
    for a, b in ((0, 1), (1, 4), (4, 40), (40, 120)):
        s.add_rows(y[a:b])
    whole = scatter(y)
    assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
    assert np.abs(s.vectors * s.values @ s.vectors.T - whole).max() <= 1e-12 * max(1, np.abs(whole).max())
    assert (np.diff(s.values) >= 0).all() and s.n == 120


def test_combined_spectra_equal_one_spectrum():
    rng = np.random.default_rng(5)
    y = rng.normal(size=(90, 12)) * 50
    parts = []
    for k in range(0, 90, 18):
        s = whitening.Spectrum(12)
        s.add_rows(y[k:k + 18])
        parts.append(whitening.Spectrum.from_bytes(s.to_bytes(), 12))
    for p in parts[1:]:
        parts[0].add(p)
    assert np.allclose(parts[0].vectors * parts[0].values @ parts[0].vectors.T, scatter(y), atol=1e-8)


def test_secular_roots_lie_between_the_poles_and_solve_the_equation():
    rng = np.random.default_rng(1)
    d = np.sort(rng.uniform(0, 100, 30))
    d[10] = d[9] + 1e-9
    w = rng.uniform(0, 1, 30) ** 6
    w /= w.sum()
    pole, mu = whitening.secular_roots(d, w, 5.0)
    roots = d[pole] + mu
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all() and roots[-1] <= d[-1] + 5
    m = np.diag(d) + 5.0 * np.outer(np.sqrt(w), np.sqrt(w))
    assert np.allclose(roots, np.linalg.eigvalsh(m), rtol=1e-13)


def brute(rows, k=8):
    """From the definition: whole numbers, covariance, eigh."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    e = n * x - s
    y = e.astype(float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return (e * e).sum(1), y @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_query_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    deviation, white, explained = brute(rows)
    got = whitening.whiten(df.repartition(7)).toPandas()
    assert len(got) == 8 * len(rows) and set(got["n"]) == {len(rows)}
    g = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    sign = np.sign((g * white).sum(0))
    assert np.abs(g * sign - white).max() < 1e-10
    first = got[got.component == 1].set_index("vec_id").loc[[i for i, _ in rows]]
    assert first["deviation"].tolist() == deviation.tolist()
    one = got[got.vec_id == rows[0][0]].sort_values("component")
    assert np.allclose(one["explained"], explained, rtol=1e-12)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-12


def test_layout_changes_nothing_beyond_rounding(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    a, b = (whitening.whiten(df.repartition(p)).toPandas().sort_values(["vec_id", "component"]) for p in (1, 40))
    assert np.abs(a["whitened"].to_numpy() - b["whitened"].to_numpy()).max() < 1e-10
    assert a["deviation"].tolist() == b["deviation"].tolist()


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    good = [(k, rng.normal(size=3).tolist()) for k in range(20)] + [(None, [0.5, 0.25, 0.125]), (3, [1.0, 2.0, 3.0])]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [nan, 0.0, 0.0]), (53, [inf, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]),
           (56, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame(good + odd, VECS)
    clash = df.select("*", *[F.lit("clash").alias(c) for c in ("id", "v", "n", "component", "lane", "m", "size")])
    got = whitening.whiten(clash).toPandas()
    assert len(got) == 3 * len(good)  # three dimensions: three components
    deviation, white, _ = brute([(i, v) for i, v in good], 3)
    assert sorted(got[got.component == 1]["deviation"]) == sorted(deviation.tolist())
    assert np.allclose(sorted(np.abs(got[got.component == 2]["whitened"])), sorted(np.abs(white[:, 1])))
    assert got["vec_id"].isna().sum() == 3 and (got.vec_id == 3).sum() == 6


def test_without_variance_and_empty(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], VECS)
    got = whitening.whiten(same).collect()
    assert len(got) == 8
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(0, None, None, None)}
    line = spark.createDataFrame([(k, [float(k), 2.0]) for k in range(4)], VECS)
    got = {(r["component"], r["whitened"] is None, r["explained"]) for r in whitening.whiten(line).collect()}
    assert got == {(1, False, 1.0), (2, True, 0.0)}
    assert whitening.whiten(same.where("false")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], VECS)).count() == 0


def test_large_entries_are_exact(spark):
    rows = [(1, [3.0e9, 1.0]), (2, [-3.0e9, 2.0]), (3, [5.0, 7.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    for (i, _), v in zip(rows, x, strict=True):
        d = sum((3 * a - b) ** 2 for a, b in zip(v, s, strict=True))
        assert got[i] == (d if d < 2**63 else None)
