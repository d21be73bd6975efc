"""Jobs that go on behind their last finished stage; stored graphs agree with their partitions; last edge wins."""

import json

import pytest
from pyspark.sql import functions as F

from semweave.operators import community as C
from semweave.plans import jobs, runs
from semweave.sources import files as FS
from semweave.sources import papers as P
from semweave.sources import tables as TB
from tests.conftest import SF001


def _vectors(spark):
    return TB.vectors_from_embeddings(TB.load_table(spark, SF001, "embeddings")).where("id < 150")


def _tables(run):
    out = {}
    for s in run.tokens:
        record = run.records(s)[-1]
        for name in record["tables"]:
            df = run.spark.read.parquet(f"{run.path}/{record['folder']}/{name or 'table'}")
            out[s, name] = sorted(map(repr, df.collect()))
    return out


def test_a_job_goes_on_behind_its_last_stage(spark, tmp_path, monkeypatch):
    papers = P.clean_papers(TB.papers_from_documents(TB.load_table(spark, SF001, "documents"))).limit(60)
    papers = spark.createDataFrame(papers.collect(), papers.schema)
    kw = {"dim": 32, "clusters": 2, "clustered": True}
    whole = runs.pipeline_run(papers, str(tmp_path / "whole"), **kw)
    want, order = _tables(whole), whole.built
    assert order == ["embeddings", "knn", "histograms", "tau", "edges", "stats", "sample", "louvain", "kmeans", "recommendation"]
    real, seen = FS.write_table, []
    for name in order[:-1]:  # stopped while the stage after ``name`` is written

        def stop(df, path, *a, name=name, **k):
            if f"/data/{order[order.index(name) + 1]}/" in path:
                real(df.limit(1), path, *a, **k)  # half a table stays behind
                raise KeyboardInterrupt
            return real(df, path, *a, **k)

        monkeypatch.setattr(FS, "write_table", stop)
        with pytest.raises(KeyboardInterrupt):
            runs.pipeline_run(papers, str(tmp_path / "cut"), **kw)
        monkeypatch.setattr(FS, "write_table", real)
        seen.append(name)
    last = runs.pipeline_run(papers, str(tmp_path / "cut"), **kw)
    assert last.built == order[-1:] and _tables(last) == want
    assert runs.pipeline_run(papers, str(tmp_path / "cut"), **kw).built == []


def test_changed_parameters_and_inputs_rebuild_what_reads_them(spark, tmp_path):
    v, path = _vectors(spark), str(tmp_path / "g")
    assert runs.graph_run(v, path, k_graph=9).built == ["knn", "histograms", "tau", "edges", "stats"]
    assert runs.graph_run(v, path, k_graph=9, pkeep=0.1).built == ["tau", "edges", "stats"]
    assert runs.graph_run(v, path, k_graph=9, symmetry="union").built == ["edges", "stats"]
    assert runs.graph_run(v, path, k_graph=9).built == []  # the first version is still there
    assert len(runs.graph_run(v.where("id < 100"), path, k_graph=9).built) == 5
    (tmp_path / "g" / "manifest" / "knn@000099-x.json").write_text('{"stage": "knn", "tok')  # a stopped writer
    assert runs.graph_run(v, path, k_graph=9).built == []


def test_eda_run(spark, tmp_path):
    papers = P.clean_papers(TB.papers_from_documents(TB.load_table(spark, SF001, "documents")))
    run = runs.eda_run(papers, str(tmp_path / "e"))
    assert run.built == ["paper_stats", "eda"] and runs.eda_run(papers, str(tmp_path / "e")).built == []
    rec = run.records("eda")[-1]
    assert json.dumps(rec["params"]) == '{"bins": 50}'
    assert spark.read.parquet(f"{run.path}/{rec['folder']}/stats").first()["total_papers"] == 200
    with pytest.raises(RuntimeError):
        runs.eda_run(papers.where("false"), str(tmp_path / "none"))


@pytest.mark.parametrize("symmetry", ["union", "mutual"])
def test_stored_sweep_agrees_with_its_edges(spark, tmp_path, symmetry):
    v = _vectors(spark)
    out = jobs.tau_sweep_job(v, knn=jobs.knn_table(v, 9), pkeep=(0.1, 0.25), symmetry=symmetry)
    jobs.save_sweep(out, str(tmp_path))
    edges, part = FS.read_edges(spark, f"{tmp_path}/edges"), FS.read_partition(spark, f"{tmp_path}/louvain")
    own = {r["tau_tag"]: r["modularity"] for r in C.modularity_by_graph(edges, part, "tau_tag").collect()}
    told = {r["tau_tag"]: r["modularity"] for r in spark.read.parquet(f"{tmp_path}/louvain_summary").collect()}
    assert own.keys() == {t for t, q in told.items() if q is not None}
    assert all(own[t] == pytest.approx(told[t], abs=1e-9) for t in own)


def test_the_last_edge_of_a_file_counts(spark, tmp_path):
    lines = ["src\tdst\tdist\tweight", "0\t1\t0.0\t9.0", "1\t2\t0.0\t1.0", "0\t3\t0.0\t1.0", "1\t0\t0.9\t0.001", "x\ty"]
    (tmp_path / "edges.tsv").write_text("\n".join(lines) + "\n")
    run = runs.louvain_run(spark, str(tmp_path / "edges.tsv"), str(tmp_path / "out"), fmt="tsv")
    rec = run.records("louvain")[-1]
    got = spark.read.parquet(f"{run.path}/{rec['folder']}/partition").collect()
    assert {r.node: r.community for r in got} == {0: 0, 3: 0, 1: 1, 2: 1}
    e = FS.read_edges(spark, str(tmp_path / "edges.tsv"), "tsv", order_col="position")
    assert [r["weight"] for r in e.orderBy("position").collect()] == [9.0, 1.0, 1.0, 0.001]
    assert e.where(F.col("position").isNull()).count() == 0
