"""Adapters from the parquet test tables to the library's abstractions.

``documents`` stands in for the paper corpus: ``paper_id = doc_id``,
``abstract = text``, ``title`` = first line of the text, and a synthetic
update date ``{2007 + doc_id % 18}-01-15`` (the table has no date column).
``embeddings`` gives the vectors (``id = vec_id``) and, in ``label``, a
ready-made partition for the community measures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semweave.functions.text import first_line


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def papers_from_documents(documents: DataFrame) -> DataFrame:
    """Raw paper records ``(paper_id, update_date, title, abstract)``."""
    return documents.select(
        F.col("doc_id").cast("long").alias("paper_id"),
        F.concat((F.lit(2007) + F.pmod(F.col("doc_id"), F.lit(18))).cast("string"),
                 F.lit("-01-15")).alias("update_date"),
        first_line(F.col("text")).alias("title"),
        F.col("text").alias("abstract"),
    )


def vectors_from_embeddings(embeddings: DataFrame) -> DataFrame:
    """``(id long, embedding array<float>)``."""
    return embeddings.select(F.col("vec_id").cast("long").alias("id"), "embedding")


def node_table(vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """Declared graph nodes ``(node long)``: every vector, isolated or not."""
    return vectors.select(F.col(id_col).cast("long").alias("node"))


def label_partition(embeddings: DataFrame) -> DataFrame:
    """The ``label`` column as a partition ``(node, community)``."""
    return embeddings.select(F.col("vec_id").cast("long").alias("node"),
                             F.col("label").cast("long").alias("community"))


def quality_partition(labels: DataFrame) -> DataFrame:
    """A partition covering only some nodes: ``labels.quality`` per doc."""
    return labels.select(F.col("doc_id").cast("long").alias("node"),
                         F.col("quality").cast("long").alias("community"))


def duplicate_edges(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Weighted graph linking exact-duplicate texts, as stars.

    Each document is linked (weight 1) to the smallest id carrying the same
    text. A star keeps the edge count linear in the group size even when
    one text is repeated across a large share of the corpus, and its
    connected components are exactly the duplicate groups.

    Texts are read once and reduced to a 128-bit key (two independent
    64-bit hashes; the chance that two different texts collide is about
    n² / 2^129, i.e. below 1e-14 even for 10^12 documents), so neither the
    aggregation nor the join shuffles any text. A hot key (one text
    repeated across a third of the corpus) is a partial aggregate on one
    side and a skewed equi-join that AQE splits on the other.
    """
    from semweave.session import materialize

    t = F.col(text_col)
    keyed = materialize(documents.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("dup-key"), t).alias("h2")), "dup_keys")
    roots = keyed.groupBy("h1", "h2").agg(F.min("id").alias("root"))
    j = keyed.join(roots, ["h1", "h2"])
    return (j.filter(F.col("id") != F.col("root"))
            .select(F.col("root").alias("src"), F.col("id").alias("dst"),
                    F.lit(0.0).alias("dist"), F.lit(1.0).alias("weight")))
