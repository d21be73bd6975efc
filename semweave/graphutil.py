"""Small join helpers shared by graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_communities(edges: DataFrame, partition: DataFrame, how: str = "inner") -> DataFrame:
    """``(src, dst, weight, c_src, c_dst)``: both endpoint communities attached."""
    p1 = partition.select(F.col("node").alias("_n1"), F.col("community").alias("c_src"))
    p2 = partition.select(F.col("node").alias("_n2"), F.col("community").alias("c_dst"))
    e = edges.select("src", "dst", "weight")
    e = e.join(p1, e["src"] == p1["_n1"], how).drop("_n1")
    return e.join(p2, e["dst"] == p2["_n2"], how).drop("_n2")
