"""File sinks and sources for the intermediate tables.

Everything is Parquet by default; tab-separated text is offered where the
reference hands files to people (edge lists, partitions). Writes always
``overwrite`` the target so a stale result can never survive a rerun.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE_SCHEMA = T.StructType([
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("dist", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
])
PARTITION_SCHEMA = T.StructType([
    T.StructField("node", T.LongType()),
    T.StructField("community", T.LongType()),
])


def path_has_data(spark: SparkSession, path: str) -> bool:
    """Whether a folder (or file) exists and holds a data file; every other problem is raised."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return False
    files = fs.listFiles(p, True)
    while files.hasNext():
        if not files.next().getPath().getName().startswith(("_", ".")):
            return True
    return False


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing was written yet. A table that is
    there but cannot be read raises, so a caller never takes it for a new one."""
    return spark.read.parquet(path) if path_has_data(spark, path) else None


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                max_records_per_file: int | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if fmt == "parquet":
        w.option("compression", "zstd").parquet(path)
    elif fmt == "tsv":
        w.option("sep", "\t").option("header", True).csv(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(fmt)


def write_edges(edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Edge lists of several thresholds go to one table partitioned by ``tau_tag``."""
    part = ["tau_tag"] if "tau_tag" in edges.columns else None
    write_table(edges, path, fmt, partition_by=part)


def read_edges(spark: SparkSession, path: str, fmt: str = "parquet", order_col: str | None = None) -> DataFrame:
    """Read an edge list; in text form malformed rows are skipped and a
    missing weight defaults to 1.0. ``order_col`` adds the place of a row:
    file, block of the file, row in the block, so that the last of parallel
    edges can be told (``normalise_edges``, ``louvain``)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = (spark.read.schema(EDGE_SCHEMA).option("sep", "\t" if fmt == "tsv" else ",")
              .option("header", True).option("mode", "DROPMALFORMED").csv(path))
    if order_col:
        df = df.withColumn(order_col, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                               F.monotonically_increasing_id().alias("row")))
    return (df.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
            .withColumn("weight", F.coalesce(F.col("weight"), F.lit(1.0))))


def write_partition(partition: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Partitions of several thresholds keep their ``tau_tag``, one folder each."""
    tag = [c for c in ("tau_tag",) if c in partition.columns]
    write_table(partition.select(*tag, "node", "community"), path, fmt, partition_by=tag or None)


def read_partition(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read ``(node, community)``; text rows that are blank or not integers are skipped."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = (spark.read.schema(PARTITION_SCHEMA).option("sep", "\t" if fmt == "tsv" else ",")
              .option("header", True).option("mode", "DROPMALFORMED").csv(path))
    return df.filter(F.col("node").isNotNull() & F.col("community").isNotNull())


def write_embeddings(embeddings: DataFrame, path: str, shard_size: int = 25_000,
                     mode: str = "overwrite") -> None:
    """Embeddings with their metadata columns, at most ``shard_size`` rows per file."""
    (embeddings.write.mode(mode).option("maxRecordsPerFile", int(shard_size))
     .option("compression", "zstd").parquet(path))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Read an embeddings table; an empty or missing folder is an error."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise RuntimeError(f"no embeddings found under {path}")
    return df


def write_one_row_json(df: DataFrame, path: str) -> None:
    """Summaries (one row) as a single JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def require_columns(df: DataFrame, required: list[str], what: str = "table") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def paper_metadata(papers: DataFrame) -> DataFrame:
    """``(paper_id, year, title)`` — the id-keyed metadata the reference
    kept in line-aligned side files."""
    return papers.select("paper_id", "year", "title")


def write_best_config(best: DataFrame, path: str, graph_dir: str, louvain_dir: str) -> None:
    """Persist the chosen graph: ``pkeep, tau`` (3 places), ``modularity,
    num_communities`` and where its edges and partition live."""
    row = best.select(
        F.col("p_keep").alias("pkeep"), F.round("tau", 3).alias("tau"), "modularity", "num_communities",
        "tau_tag",
        F.lit(graph_dir).alias("graph_dir"), F.lit(louvain_dir).alias("louvain_dir"),
        F.concat(F.lit(graph_dir.rstrip("/") + "/tau_tag="), F.col("tau_tag")).alias("edges_path"),
    )
    write_one_row_json(row, path)


def load_best_partition(spark: SparkSession, config_path: str) -> DataFrame | None:
    """Partition of the chosen graph, or None when no configuration exists
    (recommendations are then made without community labels)."""
    import warnings

    cfg = spark.read.json(config_path).first() if path_has_data(spark, config_path) else None
    if cfg is None:
        warnings.warn(f"no best-graph configuration at {config_path}; no community labels")
        return None
    part = read_partition(spark, cfg["louvain_dir"])
    if "tau_tag" in part.columns:
        part = part.filter(F.col("tau_tag").cast("string") == str(cfg["tau_tag"])).drop("tau_tag")
    return part
