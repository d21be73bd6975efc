"""A stored inverted file for exact cosine look-ups.

:func:`build_index` fits cosine k-means cells on all vectors and writes

* ``vectors``: ``(id, vec, cell)``, unit vectors as binary doubles,
  partitioned by ``cell``;
* ``cells``: ``(cell, n, radius, centre)``; ``radius`` is the largest angle
  between a member and the centre.

:func:`index_lookup` answers look-ups exactly. On the unit sphere angles obey
the triangle inequality, so no member of a cell is nearer to a query than
``angle(query, centre) - radius``. The cells nearest to a query are read
first; the k-th distance found there bounds the answer, and of the other
cells only those whose bound is not beyond it are read. Both reads join the
partition column with the table of wanted cells, which Spark turns into
dynamic partition pruning: files of other cells are not opened. In the first
read, of a few cells a query, cells and queries meet in bounded sub-blocks
(``knn._bucketed_candidates``), so a cell that holds a third of the vectors is
many groups. In the second a query may want many cells, all of them where
cells overlap: it is sent once with their list, and the cells stream past
bounded sets of queries (``knn.stream_nearest``). Any number of queries goes
the same way.

The vectors of query ids are taken from the index as well, by the cells in
which the ids lie. Zero vectors have distance 1 to all and no angle: they are kept in a cell
of their own with radius pi, so they are read for every query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semweave.functions.arrow import list_array, pack, unpack
from semweave.operators import knn as K
from semweave.session import drop_materialized, materialize, ship_package

SLACK = 1e-7  # angles: rounding of the arc cosine
EQUAL = 1e-9  # distances below count as zero (knn), so they tie
ZERO_CELL = -1
_ROWS = 1024  # queries whose cells are found at a time


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def build_index(vectors: DataFrame, path: str, *, id_col: str = "id", vec_col: str = "embedding",
                n_cells: int | None = None, seed: int = 42, max_iter: int = 20) -> None:
    """Write the index of ``vectors`` (unique ids) under ``path``; an index that is there is replaced."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    ship_package(spark)
    v = K._prep(vectors, id_col, vec_col)
    shape = v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not shape["n"]:
        raise ValueError("no vectors")
    if n_cells is None:
        n_cells = max(1, min(int(round(math.sqrt(shape["n"]))), K.MAX_BROADCAST_BYTES // (8 * max(1, shape["d"]))))
    features = array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features")
    some = v.where(F.exists("vec", lambda x: x != 0)).select(features)
    if n_cells > 1 and not some.isEmpty():
        fit = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=max_iter)
        centres = fit.fit(some).clusterCenters()
    else:
        centres = [np.ones(shape["d"])]  # one cell: any centre will do
    c = np.array([np.asarray(x, dtype=np.float64) for x in centres])
    K._check_broadcast(len(c), c.shape[1], "cells")
    c /= np.maximum(np.linalg.norm(c, axis=1), 1e-300)[:, None]
    bc = spark.sparkContext.broadcast(c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = unpack(b.column(1))
                cos = m @ bc.value.T
                cell = cos.argmax(1)
                angle = _angle(cos[np.arange(len(m)), cell])
                zero = ~m.any(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(np.where(zero, ZERO_CELL, cell).astype(np.int32)),
                     pa.array(np.where(zero, math.pi, angle))], ["id", "vec", "cell", "angle"])

    placed = materialize(K._unit(v).mapInArrow(assign, "id long, vec binary, cell int, angle double"), "cells")
    # a large cell is several files, a small one one: rows go by (cell, part of the id)
    parts = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(shape["n"] / n_cells / 500_000))))
    placed.select("id", "vec", "cell").repartition("cell", parts).write.mode("overwrite").partitionBy("cell").parquet(
        path.rstrip("/") + "/vectors")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    centre = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(c)], "cell int, centre binary")
    cells.join(centre, "cell", "left").write.mode("overwrite").parquet(path.rstrip("/") + "/cells")
    drop_materialized(placed)
    bc.unpersist()


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(vectors(id, vec, cell), cells(cell, n, radius, centre))``."""
    base = path.rstrip("/")
    return (spark.read.schema("id long, vec binary, cell int").parquet(base + "/vectors"),
            spark.read.schema("cell int, n long, radius double, centre binary").parquet(base + "/cells"))


def _read_cells(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """The index rows of the wanted cells; other cells' files are pruned at run time."""
    # the comparison (true of all cells) is what makes Spark take the join for a selective one
    keys = wanted.where(F.col("cell") >= ZERO_CELL).select(F.col("cell").alias("_c")).distinct()
    return vectors.join(F.broadcast(keys), vectors["cell"] == keys["_c"], "left_semi")  # a row a cell at most


def _wanted(queries: DataFrame, cells: DataFrame, nearest: int | None) -> DataFrame:
    """``(id, vec, probes)``: the ``nearest`` cells of each query, or those within ``reach`` (not yet read)."""
    rows = sorted(cells.collect(), key=lambda r: r["cell"])  # a row a cell, below the broadcast bound when built
    real = [r for r in rows if r["centre"] is not None]
    number = np.array([r["cell"] for r in real], np.int32)
    centre = np.array([np.frombuffer(r["centre"]) for r in real])
    radius = np.array([r["radius"] for r in real])
    held = np.array([r["n"] for r in real])
    zero = any(r["cell"] == ZERO_CELL for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                b = whole.slice(start, _ROWS)
                q = unpack(b.column(1))
                angle = _angle(q @ centre.T) if len(number) else np.zeros((len(q), 0))
                if nearest is not None:
                    order = np.argsort(angle, axis=1, kind="stable")
                    # enough cells for so many vectors
                    some = np.cumsum(held[order], 1) - held[order] < nearest
                    hit = np.zeros_like(some)
                    np.put_along_axis(hit, order, some, 1)
                else:
                    reach = b.column(2).to_numpy(zero_copy_only=False)
                    hit = angle - radius <= reach[:, None] + SLACK
                    hit |= ~q.any(1)[:, None]  # a zero query is as far from all
                    done = b.column(3).to_pylist()
                    for i, cs in enumerate(done):
                        hit[i, np.isin(number, cs)] = False
                names = number
                if nearest is not None and zero:
                    names = np.concatenate([[ZERO_CELL], number]).astype(np.int32)
                    hit = np.concatenate([np.ones((len(q), 1), bool), hit], 1)
                some = hit.any(1)
                ends = np.concatenate([[0], np.cumsum(hit[some].sum(1))])
                probes = list_array(names[np.nonzero(hit[some])[1]], ends, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pack(q[some]), probes],
                                                 ["id", "vec", "probes"])

    return queries.mapInArrow(run, "id long, vec binary, probes array<int>")


def _cells_of(wanted: DataFrame) -> DataFrame:
    return wanted.select(F.explode("probes").alias("cell"))


def _nearest_in(vectors: DataFrame, wanted: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Few cells a query: every (query, cell) is a row."""
    home = _read_cells(vectors, _cells_of(wanted)).select("id", "vec", F.col("cell").alias("bucket"))
    return K._bucketed_candidates(home, wanted.select("id", "vec", F.explode("probes").alias("bucket")), k, block_rows,
                                  dedup=False)


def query_vectors(vectors: DataFrame, query_ids: DataFrame, query_id_col: str = "id") -> DataFrame:
    """``(id, vec)`` of ids in the index: their cells first (ids and partition values only), then those cells."""
    q = query_ids.select(F.col(query_id_col).cast("long").alias("qid")).where("qid is not null").distinct()
    where = materialize(vectors.select("id", "cell").join(q, F.col("id") == F.col("qid"), "left_semi"), "query_cells")
    there = _read_cells(vectors, where)
    return there.join(where.select(F.col("id").alias("qid")), F.col("id") == F.col("qid"), "left_semi").select("id", "vec")


def index_lookup(spark: SparkSession, path: str, query_ids: DataFrame, k: int, *, query_id_col: str = "id",
                 first: int | None = None, block_rows: int = 4096) -> DataFrame:
    """Neighbours of the given ids: ``knn(src, dst, rank, dist)``, the rows of ``knn.knn_lookup``.

    ``first``: the cells read first hold so many vectors at least (4 k + 1 by
    default); more of them give a closer bound for the rest. Ids that the
    index does not hold give no rows.
    """
    ship_package(spark)
    vectors, cells = open_index(spark, path)
    queries = materialize(query_vectors(vectors, query_ids, query_id_col), "queries")
    near = materialize(_wanted(queries, cells, first or 4 * k + 1), "near_cells")
    found = materialize(_nearest_in(vectors, near, k, block_rows), "near")
    last = found.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"))
    read = near.select(F.col("id").alias("rid"), F.explode("probes").alias("cell")).groupBy("rid").agg(
        F.collect_list("cell").alias("done"))
    # distances are rounded to 12 places
    far = F.greatest(F.lit(-1.0), 1 - 2e-12 - F.greatest(F.col("far"), F.lit(EQUAL)))
    reach = F.when(F.col("n") >= k, F.acos(far)).otherwise(F.lit(math.pi))
    bounded = queries.join(last, F.col("id") == F.col("src"), "left").join(read, F.col("id") == F.col("rid"), "left").select(
        "id", "vec", F.coalesce(reach, F.lit(math.pi)).alias("reach"), F.coalesce("done", F.array()).alias("done"))
    rest = materialize(_wanted(bounded, cells, None), "far_cells")
    more = K.stream_nearest(_read_cells(vectors, _cells_of(rest)), rest, k, K._sets(rest, rest.count(), cells=cells.count()))
    cand = found.select("src", "dst", "dist").unionByName(more.select("src", "dst", "dist"))
    return K.final_topk(cand, k)


def cells_read(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The index rows that a look-up of ``wanted(cell)`` reads (for plans and counts)."""
    return _read_cells(open_index(spark, path)[0], wanted)
