"""Jobs that can be taken up again: stages with a manifest and versioned folders.

A stage has a name, parameters and inputs. Its tables are written to a
folder of their own (``data/<stage>/<version>``), and only when all of them
are there one small file is added to ``manifest/``, which names the folder
and the fingerprint of all that went in. Nothing is renamed or overwritten, so a
reader never sees half a stage, and a job that was stopped goes on behind
its last finished stage. A stage whose inputs or parameters have changed is
built again under the next version, and so are the stages that read it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semweave.operators import community as C
from semweave.operators import distance as D
from semweave.operators import graph as G
from semweave.operators import text as X
from semweave.operators.cluster import kmeans_assign, kmeans_fit
from semweave.operators.embed import hashing_embedder
from semweave.operators.knn import knn_join
from semweave.operators.louvain import louvain
from semweave.operators.recommend import recommend_sample
from semweave.plans import jobs
from semweave.sources import files as FS


def fingerprint(df: DataFrame) -> str:
    """Rows and a sum of row hashes: equal for equal tables in any order."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}:{r['h']}"


class Run:
    """The stages under one folder; ``built`` lists those that this object had to build."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.tokens: dict[str, str] = {}
        self.built: list[str] = []

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def records(self, stage: str) -> list[dict]:
        """The finished versions of a stage, oldest first."""
        fs, folder = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        found = [str(f.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().startswith(stage + "@")]
        if not found:
            return []
        rows = self.spark.read.text(sorted(found), wholetext=True).collect()  # a small file a version
        records = []
        for r in rows:
            try:
                records.append(json.loads(r["value"]))
            except ValueError:
                continue  # the file of a writer that was stopped: as if it were not there
        return sorted(records, key=lambda r: r["version"])

    def _publish(self, record: dict) -> None:
        name = f"{self.path}/manifest/{record['stage']}@{record['version']:06d}-{uuid.uuid4().hex[:8]}.json"
        fs, p = self._fs(name)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        out.close()

    def stage(self, name: str, build: Callable[[], DataFrame | dict], *, params: dict | None = None,
              after: tuple[str, ...] = (), sources: tuple[DataFrame, ...] = ()) -> dict[str, DataFrame] | DataFrame:
        """The tables of a stage, read from its folder; built first if there is no version of the same origin.

        ``after`` names the stages it reads, ``sources`` the tables from outside.
        """
        origin = json.dumps([name, params or {}, [self.tokens[s] for s in after], [fingerprint(s) for s in sources]],
                            sort_keys=True, default=str)
        token = hashlib.sha256(origin.encode()).hexdigest()
        self.tokens[name] = token
        done = self.records(name)
        record = next((r for r in reversed(done) if r["token"] == token), None)
        if record is None:
            made = build()
            tables = made if isinstance(made, dict) else {"": made}
            record = {"stage": name, "token": token, "version": done[-1]["version"] + 1 if done else 1,
                      "folder": f"data/{name}/{uuid.uuid4().hex}", "tables": sorted(tables), "params": params or {}}
            for t, df in tables.items():
                FS.write_table(df, f"{self.path}/{record['folder']}/{t or 'table'}")
            self._publish(record)
            self.built.append(name)
        read = {t: self.spark.read.parquet(f"{self.path}/{record['folder']}/{t or 'table'}") for t in record["tables"]}
        return read[""] if list(read) == [""] else read


def eda_run(papers: DataFrame, path: str, bins: int = 50) -> Run:
    """:func:`jobs.eda_job` with its results stored."""
    run = Run(papers.sparkSession, path)
    stats = run.stage("paper_stats", lambda: X.paper_stats(papers), sources=(papers,))
    if stats.isEmpty():
        raise RuntimeError("No valid papers found. Check the input path and min_year filter.")
    run.stage("eda", lambda: {"stats": X.eda_stats(stats), "years": X.year_distribution(stats),
                              "lengths": X.length_histogram(stats, bins)}, params={"bins": bins}, after=("paper_stats",))
    return run


def graph_run(vectors: DataFrame, path: str, *, papers: DataFrame | None = None, tau: float | None = None,
              pkeep: float = jobs.PKEEP, k_graph: int = jobs.K_GRAPH, symmetry: str = "forward",
              sample: int = 1000, clustered: bool = False, seed: int = 42, run: Run | None = None) -> Run:
    """kNN, histograms, summary, τ, edges, statistics, titled sample (with ``papers``) and, if ``clustered``, Louvain."""
    run = run or Run(vectors.sparkSession, path)
    if vectors.isEmpty():
        raise RuntimeError("no embeddings")
    k = max(k_graph, jobs.K_HIST)
    knn = run.stage("knn", lambda: knn_join(vectors, k), params={"k": k}, sources=(vectors.select("id", "embedding"),))
    hist = run.stage("histograms", lambda: {
        "all": D.distance_histogram(knn, jobs.K_HIST), "by_rank": D.rank_histograms(knn, jobs.K_HIST),
        "summary": D.distance_summary(knn, jobs.K_HIST)}, after=("knn",))
    cut = run.stage("tau", lambda: run.spark.createDataFrame(
        [(tau if tau is not None else D.choose_tau(hist["all"], pkeep), pkeep)], "tau double, p_keep double"),
        params={"tau": tau, "pkeep": pkeep}, after=("histograms",)).first()["tau"]
    edges = run.stage("edges", lambda: G.similarity_graph(knn.filter(F.col("rank") <= k_graph), cut, symmetry),
                      params={"k": k_graph, "symmetry": symmetry}, after=("knn", "tau"))
    nodes = vectors.select(F.col("id").alias("node"))
    run.stage("stats", lambda: G.graph_stats(nodes, edges), after=("edges",))
    if papers is not None:
        run.stage("sample", lambda: G.edge_title_sample(edges, papers, sample), params={"n": sample}, after=("edges",),
                  sources=(papers.select("paper_id", "title"),))
    if clustered:
        def cluster():
            part, summary = louvain(edges, nodes, seed=seed)
            return {"partition": part, "summary": summary, "sizes": C.community_sizes(part)}
        run.stage("louvain", cluster, params={"seed": seed}, after=("edges",))
    return run


def pipeline_run(papers: DataFrame, path: str, *, dim: int = 512, clusters: int = 0, seed: int = 42, **graph) -> Run:
    """Embed → graph (:func:`graph_run`) → optional k-means → one sample recommendation, every stage stored."""
    run = Run(papers.sparkSession, path)
    emb = run.stage("embeddings", lambda: hashing_embedder(papers, dim).select(
        F.col("paper_id").alias("id"), "embedding"), params={"dim": dim}, sources=(papers,))
    graph_run(emb, path, papers=papers, seed=seed, run=run, **graph)
    if clusters > 0:
        run.stage("kmeans", lambda: kmeans_assign(emb, kmeans_fit(emb, clusters, seed)),
                  params={"clusters": clusters, "seed": seed}, after=("embeddings",))
    run.stage("recommendation", lambda: recommend_sample(emb, papers, None, 5, seed), params={"seed": seed},
              after=("embeddings",))
    return run


def louvain_run(spark: SparkSession, edges_path: str, path: str, fmt: str = "parquet", seed: int = 42) -> Run:
    """Communities of a stored edge list; of parallel edges the last in file order counts."""
    run = Run(spark, path)
    edges = FS.read_edges(spark, edges_path, fmt, order_col="position")

    def cluster():
        part, summary = louvain(edges, seed=seed, order_col="position")
        return {"partition": part, "summary": summary}

    run.stage("louvain", cluster, params={"edges": edges_path, "seed": seed}, sources=(edges.drop("position"),))
    return run
