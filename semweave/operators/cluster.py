"""k-means on embeddings and nearest-centroid assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.functions.arrow import unit, unit_matrix
from semweave.operators.knn import MAX_BROADCAST_BYTES
from semweave.session import drop_materialized, materialize


def _features(vectors: DataFrame, vec_col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.withColumn("features", array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))))


def kmeans_fit(vectors: DataFrame, k: int, seed: int = 42, max_iter: int = 20, vec_col: str = "embedding",
               distance: str = "euclidean"):
    """Full-batch distributed k-means (k-means|| initialisation). ``k <= 0``
    returns None (clustering disabled, as in the reference's default)."""
    from pyspark.ml.clustering import KMeans

    if k <= 0:
        return None
    km = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure=distance, featuresCol="features",
                predictionCol="cluster")
    return km.fit(_features(vectors, vec_col))


def kmeans_assign(vectors: DataFrame, model, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``(id, cluster)`` for every vector."""
    out = model.transform(_features(vectors, vec_col))
    return out.select(F.col(id_col).alias("id"), F.col("cluster").cast("int").alias("cluster"))


def label_centroids(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label ``(label, centroid array<double>)``.

    One vector aggregate per label (map-side sums), no row per entry.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    means = _features(vectors.where(F.col(vec_col).isNotNull()), vec_col).groupBy(F.col(label_col).alias("label"))
    return means.agg(Summarizer.mean(F.col("features")).alias("_m")).select(
        "label", vector_to_array("_m").alias("centroid"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, id_col: str = "id",
                     vec_col: str = "embedding", key_col: str = "label",
                     centroid_col: str = "centroid") -> DataFrame:
    """Assign each vector to the centroid of smallest cosine distance.

    The centroid table is small by construction (one row per cluster); it
    is collected once, its size checked, and broadcast to a vectorised
    scan of the vectors: ``(id, nearest, dist)``; ties go to the smaller key.
    """
    from semweave.session import ship_package

    ship_package(vectors.sparkSession)
    cents = materialize(centroids.select(key_col, centroid_col), "centroids")  # evaluated once
    size = cents.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(centroid_col)).alias("dim")).first()
    if size["n"] == 0:
        raise ValueError("no centroids")
    if size["n"] * size["dim"] * 8 > MAX_BROADCAST_BYTES:  # checked before anything is collected
        raise ValueError(f"centroid table of {size['n']} x {size['dim']} is too large to broadcast")
    rows = sorted(cents.collect(), key=lambda r: r[key_col])
    drop_materialized(cents)
    keys = np.array([r[key_col] for r in rows], dtype=np.int64)
    cmat = unit(np.array([r[centroid_col] for r in rows], dtype=np.float64))
    bc = vectors.sparkSession.sparkContext.broadcast((keys, cmat))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, cm = bc.value
        for b in batches:
            if b.num_rows:
                d = 1.0 - unit_matrix(b.column(1)) @ cm.T
                j = np.argmin(d, axis=1)  # first minimum = smallest key
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ks[j]), pa.array(d[np.arange(len(d)), j])],
                                                 ["id", "nearest", "dist"])

    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return v.mapInArrow(assign, "id long, nearest long, dist double")
