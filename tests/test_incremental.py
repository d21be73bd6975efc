"""Incremental embedding never loses, doubles or moves rows; the sweep's sinks can be read back."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from semweave.operators.embed import fit_idf, hashing_embedder, model_embedder
from semweave.operators.louvain import louvain
from semweave.operators.recommend import recommend
from semweave.plans import jobs
from semweave.sources import files as FS
from semweave.sources import tables as TB
from tests.conftest import SF001

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def _jsonl(path, names):
    rows = [{"update_date": "2020-01-15", "title": n, "abstract": f"{n} " + " ".join(WORDS)} for n in names]
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")


def test_unreadable_file_raises_and_keeps_all_rows(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "emb"
    src.mkdir()
    _jsonl(src / "a.jsonl", [f"paper{k}" for k in range(50)])
    assert jobs.embed_job(spark, str(src), str(out)) == 50
    before = {p.name for p in out.glob("part-*")}
    (out / "part-99999-broken.parquet").write_bytes(b"not parquet at all")
    _jsonl(src / "b.jsonl", ["new0", "new1"])
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader says
        jobs.embed_job(spark, str(src), str(out))
    (out / "part-99999-broken.parquet").unlink()
    assert before <= {p.name for p in out.glob("part-*")}
    assert jobs.embed_job(spark, str(src), str(out)) == 52


def test_added_file_stores_every_paper_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "emb")
    src.mkdir()
    _jsonl(src / "b.jsonl", ["alpha", "beta"])
    assert jobs.embed_job(spark, str(src), out) == 2
    _jsonl(src / "a.jsonl", [f"gamma{k}" for k in range(5)] + ["alpha"])  # sorts before the first file
    assert jobs.embed_job(spark, str(src), out) == 7
    titles = [r["title"] for r in spark.read.parquet(out).collect()]
    assert sorted(titles) == sorted(["alpha", "beta"] + [f"gamma{k}" for k in range(5)])


def test_same_text_in_two_batches_has_one_vector(spark):
    text = "the same text of words"
    a = spark.createDataFrame([(1, text), (2, "other words here")], "paper_id long, abstract string")
    b = spark.createDataFrame([(3, text), (4, "quite different things again")], "paper_id long, abstract string")
    idf = fit_idf(a.unionByName(b), 64)
    for kw in ({}, {"idf": idf}):
        x = hashing_embedder(a, 64, **kw).where("paper_id = 1").first()["embedding"]
        y = hashing_embedder(b, 64, **kw).where("paper_id = 3").first()["embedding"]
        assert x == y and abs(np.linalg.norm(x) - 1) < 1e-6
    assert hashing_embedder(a.where("false"), 64).count() == 0


def test_model_embedder_and_read_embeddings(spark, tmp_path):
    def make():
        def predict(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return predict

    df = spark.createDataFrame([(1, "abc"), (2, "de")], "paper_id long, abstract string")
    got = model_embedder(df, make, 2, batch_size=2)
    assert {r.paper_id: list(r.embedding) for r in got.collect()} == {1: [3.0, 1.0], 2: [2.0, 1.0]}
    FS.write_embeddings(got, str(tmp_path / "emb"), shard_size=1)
    assert FS.read_embeddings(spark, str(tmp_path / "emb")).count() == 2
    got.where("false").write.parquet(str(tmp_path / "none"))
    with pytest.raises(RuntimeError):
        FS.read_embeddings(spark, str(tmp_path / "none"))


def test_sweep_written_and_read_back(spark, tmp_path):
    v = TB.vectors_from_embeddings(TB.load_table(spark, SF001, "embeddings"))
    out = jobs.tau_sweep_job(v, pkeep=(0.10, 0.20))
    jobs.save_sweep(out, str(tmp_path))
    best = out["best"].first()
    part = FS.load_best_partition(spark, str(tmp_path / "best"))
    want = out["partition"].where(F.col("tau_tag") == best["tau_tag"]).select("node", "community")
    assert part.columns == ["node", "community"] and part.exceptAll(want).count() == want.exceptAll(part).count() == 0
    assert FS.read_edges(spark, str(tmp_path / "edges")).where(F.col("tau_tag") == best["tau_tag"]).count() > 0
    papers = TB.papers_from_documents(TB.load_table(spark, SF001, "documents")).withColumn("year", F.lit(2020))
    rec = recommend(spark.range(3), v, papers, part, 4).collect()
    assert len(rec) == 12 and len({(r.query_id, r.rank) for r in rec}) == 12
    with pytest.raises(ValueError):
        recommend(spark.range(10**9, 10**9 + 1), v, papers, part, 4)
    with pytest.raises(RuntimeError):
        jobs.select_best_tau(out["quality"].withColumn("num_communities", F.lit(1)))


def test_changed_vectors_rebuild_the_knn_table(spark, tmp_path):
    v = TB.vectors_from_embeddings(TB.load_table(spark, SF001, "embeddings")).limit(80)
    path = str(tmp_path / "knn")
    a = {(r.src, r.dst) for r in jobs.knn_table(v, 3, path=path).collect()}
    moved = v.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)))
    moved = moved.withColumn("embedding", F.when(F.col("id") % 2 == 0, F.col("embedding")).otherwise(
        F.reverse("embedding")))
    b = {(r.src, r.dst) for r in jobs.knn_table(moved, 3, path=path).collect()}
    assert a != b


def test_louvain_says_when_a_bound_cut_it_short(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(200)], "src long, dst long, weight double")
    _, whole = louvain(path)
    _, short = louvain(path, max_levels=1)
    assert whole.first()["converged"] and not short.first()["converged"]
    assert whole.first()["modularity"] > short.first()["modularity"]


def test_first_papers(spark):
    from semweave.sources.papers import first_papers

    df = spark.createDataFrame([(3,), (1,), (2,)], "paper_id long")
    assert [r.paper_id for r in first_papers(df, 2).orderBy("paper_id").collect()] == [1, 2]
    with pytest.raises(ValueError):
        first_papers(df, 0)


def test_louvain_keeps_the_last_of_parallel_edges(spark):
    rows = [(0, 1, 9.0, 1), (1, 0, 0.001, 2), (1, 2, 1.0, 1), (0, 3, 1.0, 1)]
    df = spark.createDataFrame(rows, "src long, dst long, weight double, pos int")
    last, _ = louvain(df, order_col="pos")
    assert {r.node: r.community for r in last.collect()} == {0: 0, 3: 0, 1: 1, 2: 1}


def test_exact_quantiles_of_few_values_stay_bounded(spark):
    from semweave.functions.stats import exact_quantiles

    values = [0.0] * 700 + [1.0] * 900 + [2.5] * 400
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", [0.1, 0.349, 0.35, 0.36, 0.5, 0.9], max_exact=50)
    assert np.allclose(got, np.percentile(values, [10, 34.9, 35, 36, 50, 90]))
