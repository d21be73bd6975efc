"""Session helpers.

The library never creates a global session inside an operator; jobs and
tests call :func:`get_session` once and pass DataFrames around.
"""

from __future__ import annotations

import itertools
import math
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "semweave") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    AQE stays on so that shuffle partitions are coalesced for small inputs
    and skewed join partitions are split at run time on large ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # iterative jobs run hundreds of small jobs: keep the status store small
        "spark.ui.retainedJobs": "200",
        "spark.ui.retainedStages": "200",
        "spark.sql.ui.retainedExecutions": "100",
    }
    if master and master.startswith("local"):
        # local mode: the executors live in the driver JVM (takes effect at launch)
        conf["spark.driver.memory"] = os.environ.get("SEMWEAVE_DRIVER_MEMORY", "8g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared, fault-tolerant folder and is
    used as is. Only when it is unset (local runs and tests) is a private
    folder created, so reliable ``checkpoint()`` works everywhere.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # pragma: no cover - conf not visible through SQL
            conf_dir = None
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # unset: a private local folder, for local runs and tests
        conf_dir = tempfile.mkdtemp(prefix="semweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


_RUN_ID = uuid.uuid4().hex[:12]
_COUNTER = itertools.count()


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path for this run's own tables under the shared checkpoint folder."""
    return scratch_path(spark, f"semweave-{_RUN_ID}/{tag}-{next(_COUNTER):05d}")


def materialize(df: DataFrame, tag: str = "t", observe: dict | None = None, drop: tuple[str, ...] = ()):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This cuts the lineage like ``checkpoint()`` (the data sits in reliable
    storage, so a lost executor never forces a replay of earlier
    iterations) and, unlike a checkpointed plan, the re-read table carries
    file-size statistics, which keeps the optimizer's size estimates (and
    its broadcast decisions) accurate across many iterations.

    With ``observe`` (name -> aggregate Column), the aggregates are computed
    during the same write (``DataFrame.observe``) and ``(table, values)`` is
    returned, saving a separate counting job; columns named in ``drop`` are
    observed but not written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"semweave-{_RUN_ID}/{tag}-{next(_COUNTER):05d}")
    # the schema is known: reading it back needs no footer inference
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name not in drop])
    if observe:
        from pyspark.sql import Observation

        obs = Observation(f"obs-{tag}-{next(_COUNTER)}")
        df = df.observe(obs, *[c.alias(n) for n, c in observe.items()]).drop(*drop)
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path), obs.get
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def materialize_bucketed(df: DataFrame, column: str, tag: str = "b", keys: int | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder, bucketed by ``column``, and read it back.

    As many buckets as shuffle partitions, one file each: later jobs that
    group or join by ``column`` read the rows where they lie instead of
    shuffling them. With the number of ``keys`` given, no more than a bucket
    a key (see :func:`bucket_labels`): the others would be empty tasks of every later job.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if keys is not None:
        n = max(1, min(n, keys))
    number = next(_COUNTER)
    path = scratch_path(spark, f"semweave-{_RUN_ID}/{tag}-{number:05d}")
    name = f"semweave_{_RUN_ID}_{tag}_{number}"
    (df.repartition(n, column).write.format("parquet").bucketBy(n, column).sortBy(column).option("path", path)
     .mode("overwrite").saveAsTable(name))
    _TABLES[path.rsplit("/", 1)[1]] = name
    return spark.table(name)


def bucket_labels(spark: SparkSession, keys: int) -> list[int]:
    """``keys - 1`` numbers that lie, like -1, each in a bucket of its own of ``materialize_bucketed(keys=keys)``.

    Beyond the number of shuffle partitions buckets hold several keys anyway: 0, 1, ...
    """
    if 2 < keys <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        some = spark.range(-1, math.ceil(keys * (math.log(keys) + 20)), 1, 1)
        first = some.groupBy(F.pmod(F.hash("id"), F.lit(keys)).alias("bucket")).agg(F.min("id").alias("id")).collect()
        labels = sorted(r["id"] for r in first if r["id"] >= 0)
        if len(labels) == keys - 1:
            return labels
    return list(range(keys - 1))


_TABLES: dict[str, str] = {}  # folder -> catalog name of a bucketed table


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a table returned by :func:`materialize`."""
    spark = df.sparkSession
    try:
        files = df.inputFiles()
    except Exception:  # noqa: BLE001
        return
    if not files:
        return
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if f"semweave-{_RUN_ID}" not in folder.toString():
        return  # only ever remove this run's own intermediates
    name = _TABLES.pop(folder.getName(), None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(folder, True)


@contextmanager
def shuffles_released(spark: SparkSession):
    """Plans that run inside delete their shuffle files as they end.

    For plans that run once, such as those written by :func:`materialize`: left to itself Spark deletes the
    files only when the driver's heap happens to be collected.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_materialized(spark: SparkSession) -> None:
    """Delete every table this run has materialised; results that still read them become invalid."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, f"semweave-{_RUN_ID}"))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    for name in _TABLES.values():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    _TABLES.clear()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``.

    Vectorised kernels (``applyInPandas`` / ``mapInPandas``) are pickled by
    reference to their module, so executors must be able to import it. The
    package source is zipped once per application and distributed with
    ``SparkContext.addPyFile`` (Spark's own file distribution).
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="semweave-pkg-"), "semweave.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, dirnames, files in os.walk(pkg_dir):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
