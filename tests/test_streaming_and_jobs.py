import json
import os

from pyspark.sql import functions as F

from semweave.plans import jobs
from semweave.sources import papers as P
from semweave.sources import tables as TB
from semweave.streaming.ingest import run_embed_ingest
from tests.conftest import SF001


def _write_jsonl(path, docs):
    with open(path, "w") as f:
        for r in docs:
            f.write(json.dumps({"paper_id": r["paper_id"], "update_date": r["update_date"],
                                "title": r["title"], "abstract": r["abstract"]}) + "\n")
        f.write("not json\n")


def test_stream_ingest_is_incremental(spark, tmp_path):
    raw = TB.papers_from_documents(TB.load_table(spark, SF001, "documents")).orderBy("paper_id").collect()
    src = tmp_path / "in"
    src.mkdir()
    _write_jsonl(src / "a.jsonl", raw[:120])
    out, ck = str(tmp_path / "emb"), str(tmp_path / "ck")
    first = run_embed_ingest(spark, str(src), out, ck, min_year=0, min_words=0)
    assert first == 120
    _write_jsonl(src / "b.jsonl", raw[100:200])  # 20 rows overlap by id
    second = run_embed_ingest(spark, str(src), out, ck, min_year=0, min_words=0)
    assert second == 80
    again = run_embed_ingest(spark, str(src), out, ck, min_year=0, min_words=0)
    assert again == 0
    tab = spark.read.parquet(out)
    assert tab.count() == 200 and tab.select("paper_id").distinct().count() == 200
    assert tab.select(F.size("embedding")).distinct().collect()[0][0] == 512


def test_graph_and_sweep_jobs(spark):
    v = TB.vectors_from_embeddings(TB.load_table(spark, SF001, "embeddings"))
    g = jobs.graph_job(v)
    assert round(g["tau"], 3) == 0.65
    s = g["stats"].first()
    assert (s["edges"], s["isolated_nodes"]) == (257, 192)
    sw = jobs.tau_sweep_job(v, knn=g["knn"])
    q = sw["quality"].orderBy("p_keep").collect()
    assert len(q) == 5 and all(r["modularity"] is not None for r in q)
    best = sw["best"].collect()
    assert len(best) == 1 and best[0]["modularity"] == max(r["modularity"] for r in q if r["num_communities"] > 1)


def test_eda_job_empty_raises(spark):
    import pytest

    papers = P.clean_papers(TB.papers_from_documents(TB.load_table(spark, SF001, "documents")), min_year=3000)
    with pytest.raises(RuntimeError):
        jobs.eda_job(papers)


def test_sinks_round_trip(spark, tmp_path):
    from semweave.sources import files as FS

    e = spark.createDataFrame([(0, 1, 0.2, 0.8, "tau_0p600"), (1, 2, 0.5, None, "tau_0p600")],
                              "src long, dst long, dist double, weight double, tau_tag string")
    FS.write_edges(e, str(tmp_path / "edges"))
    back = FS.read_edges(spark, str(tmp_path / "edges"))
    assert back.count() == 2 and back.filter("weight = 1.0").count() == 1  # missing weight -> 1.0
    FS.write_table(e.drop("tau_tag"), str(tmp_path / "tsv"), fmt="tsv")
    (tmp_path / "tsv" / "zz-bad.csv").write_text("src\tdst\tdist\tweight\nx\t1\t0.1\t0.9\n")
    assert FS.read_edges(spark, str(tmp_path / "tsv"), fmt="tsv").count() == 2
    part = spark.createDataFrame([("tau_0p600", 0, 0), ("tau_0p600", 1, 0), ("tau_0p700", 1, 1)],
                                 "tau_tag string, node long, community long")
    part.write.parquet(str(tmp_path / "louvain"))
    best = spark.createDataFrame([(0.2, 0.6, 0.5, 2, "tau_0p600")],
                                 "p_keep double, tau double, modularity double, num_communities long, tau_tag string")
    FS.write_best_config(best, str(tmp_path / "best"), str(tmp_path / "edges"), str(tmp_path / "louvain"))
    got = FS.load_best_partition(spark, str(tmp_path / "best"))
    assert sorted((r.node, r.community) for r in got.collect()) == [(0, 0), (1, 0)]
    assert FS.load_best_partition(spark, str(tmp_path / "nothing")) is None
    import pytest
    with pytest.raises(ValueError):
        FS.require_columns(best, ["p_keep", "missing"])


def test_embed_job_and_pipeline(spark, tmp_path):
    raw = TB.papers_from_documents(TB.load_table(spark, SF001, "documents")).orderBy("paper_id").collect()
    src = tmp_path / "papers.jsonl"
    _write_jsonl(src, raw)
    out = str(tmp_path / "emb")
    n1 = jobs.embed_job(spark, str(src), out, min_year=2015, min_words=10)
    n2 = jobs.embed_job(spark, str(src), out, min_year=2010, min_words=10)  # adds only what is missing
    n3 = jobs.embed_job(spark, str(src), out, min_year=2015, min_words=10, force=True)
    assert 0 < n1 < n2 and n3 == n1
    papers = P.clean_papers(TB.papers_from_documents(TB.load_table(spark, SF001, "documents")))
    res = jobs.pipeline_job(papers.limit(120), clusters=3)
    assert res["stats"].first()["nodes"] == 120
    assert res["kmeans"].select("cluster").distinct().count() <= 3
    assert res["sample"].count() == 5


def test_eda_job_golden(spark):
    papers = P.clean_papers(TB.papers_from_documents(TB.load_table(spark, SF001, "documents")))
    out = jobs.eda_job(papers)
    s = out["stats"].first()
    assert (s["total_papers"], s["len_median"], s["short_10"]) == (200, 241.5, 7)
    assert out["lengths"].agg(F.sum("count")).first()[0] == 200
    assert out["years"].agg(F.sum("papers")).first()[0] == 200


def test_persisted_knn_reused_only_when_parameters_match(spark, tmp_path):
    v = TB.vectors_from_embeddings(TB.load_table(spark, SF001, "embeddings"))
    path = str(tmp_path / "knn")
    a = jobs.knn_table(v, 5, path=path)
    files_a = set(a.inputFiles())
    b = jobs.knn_table(v, 5, path=path)  # same parameters: reused as is
    assert set(b.inputFiles()) == files_a
    c = jobs.knn_table(v, 7, path=path)  # different k: rebuilt
    assert c.groupBy("src").count().first()["count"] == 7
    d = jobs.knn_table(v.filter("id < 100"), 7, path=path)  # different input size: rebuilt
    assert d.count() == 100 * 7
