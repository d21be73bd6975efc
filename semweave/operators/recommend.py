"""Neighbour recommendation with community-based significance labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.functions.text import clean_title, unknown_title
from semweave.operators.knn import knn_join, knn_lookup

RECOMMEND_COLUMNS = ["query_id", "rank", "id", "year", "title", "distance",
                     "in_partition", "same_community", "significance"]

# The two significance labels of a recommended neighbour.
SIGNIFICANT = "significant"
NON_SIGNIFICANT = "non-significant"


def with_metadata(df: DataFrame, papers: DataFrame, id_col: str = "id",
                  paper_id_col: str = "paper_id") -> DataFrame:
    """Attach ``year`` and cleaned ``title`` of ``id_col`` (left equi-join on
    the id); an id without metadata gets year null and ``<unknown {id}>``."""
    meta = papers.select(F.col(paper_id_col).cast("long").alias("_pid"), F.col("year").alias("year"),
                         clean_title(F.col("title")).alias("title"))
    return (df.join(meta, df[id_col] == meta["_pid"], "left")
            .withColumn("title", F.when(F.col("_pid").isNull(), unknown_title(F.col(id_col)))
                        .otherwise(F.col("title")))
            .drop("_pid"))


def check_ids(query_ids: DataFrame, nodes: DataFrame, id_col: str = "id") -> None:
    """Raise if any requested id is not a known node (one anti-join)."""
    bad = (query_ids.select(F.col(id_col).cast("long").alias("node"))
           .join(nodes.select("node"), "node", "left_anti").limit(5).collect())
    if bad:
        raise ValueError(f"unknown paper ids: {[r['node'] for r in bad]}")


def recommend(query_ids: DataFrame | None, vectors: DataFrame, papers: DataFrame,
              partition: DataFrame | None, k: int = 5, *, knn: DataFrame | None = None,
              id_col: str = "id", vec_col: str = "embedding", query_id_col: str = "id",
              paper_id_col: str = "paper_id") -> DataFrame:
    """``k`` nearest papers for each query id, with metadata and labels.

    ``query_ids=None`` recommends for every paper (the full kNN join, or a
    persisted ``knn`` table when given). A neighbour is *significant* when
    both it and the query are in the partition and share a community. A
    query id without a vector is an error. Metadata and both community look-ups are left equi-joins on the id.
    """
    if query_ids is not None:
        check_ids(query_ids, vectors.select(F.col(id_col).cast("long").alias("node")), query_id_col)
    if knn is not None:
        nn = knn.filter(F.col("rank") <= F.lit(k))
        if query_ids is not None:
            q = query_ids.select(F.col(query_id_col).cast("long").alias("src"))
            nn = nn.join(q, "src", "left_semi")
    elif query_ids is None:
        nn = knn_join(vectors, k, id_col=id_col, vec_col=vec_col)
    else:
        nn = knn_lookup(vectors, query_ids, k, id_col=id_col, vec_col=vec_col, query_id_col=query_id_col)
    nn = nn.select(F.col("src").alias("query_id"), "rank", F.col("dst").alias("id"),
                   F.col("dist").alias("distance"))
    out = with_metadata(nn, papers, id_col="id", paper_id_col=paper_id_col)
    if partition is None:
        return out.select("query_id", "rank", "id", "year", "title", "distance",
                          F.lit(False).alias("in_partition"), F.lit(False).alias("same_community"),
                          F.lit(NON_SIGNIFICANT).alias("significance"))
    pq = partition.select(F.col("node").alias("_qn"), F.col("community").alias("_qc"))
    pn = partition.select(F.col("node").alias("_nn"), F.col("community").alias("_nc"))
    out = out.join(pq, out["query_id"] == pq["_qn"], "left").join(pn, out["id"] == pn["_nn"], "left")
    in_part = F.col("_nn").isNotNull()
    same = in_part & F.coalesce(F.col("_qc") == F.col("_nc"), F.lit(False))
    return out.select("query_id", "rank", "id", "year", "title", "distance",
                      in_part.alias("in_partition"), same.alias("same_community"),
                      F.when(same, F.lit(SIGNIFICANT)).otherwise(F.lit(NON_SIGNIFICANT))
                      .alias("significance"))


def pick_random(nodes: DataFrame, seed: int = 42, col: str = "node") -> DataFrame:
    """One node chosen by a seeded multiplicative hash; reproducible.

    The hash is integer arithmetic (Knuth's 2654435761 multiplier modulo
    2^32, applied to the id reduced modulo 2^31 - 1 so that the product
    cannot overflow), so the same pick can be recomputed in any SQL engine.
    """
    reduced = F.pmod(F.col(col), F.lit(2147483647))
    h = F.pmod(reduced * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))
    return nodes.select(F.col(col).alias("id"), h.alias("_h")).orderBy("_h", "id").limit(1).select("id")


def recommend_sample(vectors: DataFrame, papers: DataFrame, partition: DataFrame | None,
                     k: int = 5, seed: int = 42, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Recommendation for one seeded random paper."""
    q = pick_random(vectors.select(F.col(id_col).cast("long").alias("node")), seed)
    return recommend(q, vectors, papers, partition, k, id_col=id_col, vec_col=vec_col)
