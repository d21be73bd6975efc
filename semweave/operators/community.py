"""Partition measures: modularity, sizes, coherence, representatives, terms.

A partition is ``(node long, community long)``; edges are undirected
``(src, dst, weight)`` listed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semweave.graphutil import with_communities
from semweave.operators.graph import endpoints


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Weighted modularity ``Σ_c [L_c/m − γ (K_c / 2m)²]`` as one row.

    ``L_c``: weight of edges inside c; ``K_c``: weighted degree of c;
    ``m``: total weight. Both endpoint communities are attached with two
    equi-joins, then one partial aggregation by community yields ``L_c``
    and ``K_c`` together; the final sum is over communities.
    Output ``(modularity, m, communities_touched)``; modularity is null for
    an edge-less graph.
    """
    e = with_communities(edges, partition)
    # one pass over the joined edges: each edge credits both endpoint
    # communities with its weight (degree) and, when internal, one of them
    # with its weight as internal weight
    w = F.col("weight").cast("double")
    inside = F.when(F.col("c_src") == F.col("c_dst"), w).otherwise(F.lit(0.0))
    parts = F.array(
        F.struct(F.col("c_src").alias("community"), inside.alias("L"), w.alias("K")),
        F.struct(F.col("c_dst").alias("community"), F.lit(0.0).alias("L"), w.alias("K")))
    per_c = (e.select(F.inline(parts))
             .groupBy("community").agg(F.sum("L").alias("L"), F.sum("K").alias("K")))
    tot = per_c.agg(F.sum("L").alias("sl"), F.sum(F.col("K") * F.col("K")).alias("sk2"),
                    F.sum("K").alias("sk"), F.count(F.lit(1)).alias("communities_touched"))
    m = F.col("sk") / 2
    q = F.when(m > 0, F.col("sl") / m - F.lit(resolution) * F.col("sk2") / (F.lit(4.0) * m * m))
    return tot.select(q.alias("modularity"), m.alias("m"), "communities_touched")


def modularity_by_graph(edges: DataFrame, partition: DataFrame, graph_col: str) -> DataFrame:
    """``(graph, modularity, m)`` of several graphs in one job; both tables carry ``graph_col``.

    The same sums as :func:`modularity`, keyed by (graph, community); a graph
    without edges has no row.
    """
    p = partition.select(graph_col, "node", "community")
    e = (edges.select(graph_col, "src", "dst", F.col("weight").cast("double").alias("w"))
         .join(p.withColumnsRenamed({"node": "src", "community": "c_src"}), [graph_col, "src"])
         .join(p.withColumnsRenamed({"node": "dst", "community": "c_dst"}), [graph_col, "dst"]))
    inside = F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(F.lit(0.0))
    parts = F.array(F.struct(F.col("c_src").alias("c"), inside.alias("L"), F.col("w").alias("K")),
                    F.struct(F.col("c_dst").alias("c"), F.lit(0.0).alias("L"), F.col("w").alias("K")))
    per_c = e.select(graph_col, F.inline(parts)).groupBy(graph_col, "c").agg(F.sum("L").alias("L"),
                                                                             F.sum("K").alias("K"))
    tot = per_c.groupBy(graph_col).agg(F.sum("L").alias("sl"), F.sum(F.col("K") * F.col("K")).alias("sk2"),
                                       (F.sum("K") / 2).alias("m"))
    q = F.when(F.col("m") > 0, F.col("sl") / F.col("m") - F.col("sk2") / (4.0 * F.col("m") * F.col("m")))
    return tot.select(graph_col, q.alias("modularity"), "m")


def community_sizes(partition: DataFrame) -> DataFrame:
    """``(community, size)``; isolated nodes count as singleton communities."""
    return partition.groupBy("community").agg(F.count(F.lit(1)).alias("size"))


def partition_summary(partition: DataFrame) -> DataFrame:
    """One row: number of communities, of non-trivial ones (size ≥ 2), largest size."""
    s = community_sizes(partition)
    return s.agg(F.count(F.lit(1)).alias("num_communities"),
                 F.count_if(F.col("size") >= 2).alias("num_nontrivial"),
                 F.max("size").alias("largest"))


def coherence(knn: DataFrame, partition: DataFrame, k: int = 5) -> DataFrame:
    """Share of each paper's first ``k`` neighbours in the same community.

    Returned per community of the source plus an overall row through
    ``rollup``: ``(community, pairs, same, is_total, share)``; ``is_total``
    tells the overall row from the group of sources outside the partition
    (both have a null community). Pairs whose endpoints are not both in the
    partition count as different.
    """
    nn = knn.filter(F.col("rank") <= F.lit(k)).select("src", "dst", F.lit(1.0).alias("weight"))
    e = with_communities(nn, partition, how="left")
    same = F.coalesce(F.col("c_src") == F.col("c_dst"), F.lit(False)).cast("long")
    g = (e.withColumn("same", same).withColumnRenamed("c_src", "community").rollup("community")
         .agg(F.count(F.lit(1)).alias("pairs"), F.sum("same").alias("same"),
              (F.grouping("community") == 1).alias("is_total")))
    return g.withColumn("share", F.col("same") / F.greatest(F.col("pairs"), F.lit(1)).cast("double"))


def paper_coherence(knn: DataFrame, partition: DataFrame, k: int = 5) -> DataFrame:
    """Per paper: ``(node, pairs, same, share)`` over its first ``k`` neighbours."""
    nn = knn.filter(F.col("rank") <= F.lit(k)).select("src", "dst", F.lit(1.0).alias("weight"))
    e = with_communities(nn, partition, how="left")
    same = F.coalesce(F.col("c_src") == F.col("c_dst"), F.lit(False)).cast("long")
    g = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(same).alias("same"))
    return g.withColumn("share", F.col("same") / F.col("pairs").cast("double"))


def community_representative(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Per community the node of highest intra-community weighted degree.

    Ties go to the smallest id; communities without internal edges are
    represented by their smallest member (degree 0). ``max_by`` over a
    struct keeps this a single partial aggregation per community.
    """
    e = with_communities(edges, partition).filter(F.col("c_src") == F.col("c_dst"))
    wdeg = endpoints(e, with_weight=True).groupBy("node").agg(F.sum("weight").alias("wdeg"))
    members = partition.join(wdeg, "node", "left").withColumn("wdeg", F.coalesce("wdeg", F.lit(0.0)))
    key = F.struct(F.col("wdeg"), (-F.col("node")).alias("neg_node"))
    return (members.groupBy("community")
            .agg(F.max_by(F.struct("node", "wdeg"), key).alias("r"), F.count(F.lit(1)).alias("size"))
            .select("community", F.col("r.node").alias("node"), F.col("r.wdeg").alias("intra_degree"), "size"))


TOKEN_PATTERN = r"\p{L}{3,}"


def community_terms(docs: DataFrame, partition: DataFrame, n: int = 5, id_col: str = "paper_id",
                    text_col: str = "abstract", min_df: int = 1) -> DataFrame:
    """Top ``n`` TF-IDF terms per community.

    Terms are lower-cased runs of at least three letters. ``tf`` = count of
    the term in the community's texts, ``df`` = number of communities using
    it, ``idf = ln((1 + C) / (1 + df)) + 1`` with C communities. Word counts
    are aggregated per (community, term) with map-side combine before the
    shuffle; the per-community top-n is a window limit.
    Output ``(community, rank, term, tf, df, tfidf)``.
    """
    d = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("t"))
    j = d.join(partition, "node")
    toks = j.select("community", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(TOKEN_PATTERN), 0))
                    .alias("term"))
    from semweave.session import materialize

    # texts are tokenised once: the (community, term) counts are written and
    # both the document frequency and the scoring read them back
    tf = materialize(toks.groupBy("community", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    # document frequency over communities: an aggregation joined back (a
    # common term is in every community; a window keyed by term would put
    # all of them in one task)
    dfc = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n_comm = partition.select("community").distinct().count()  # scalar
    scored = (tf.join(dfc, "term")
              .filter(F.col("df") >= F.lit(min_df))
              .withColumn("tfidf", F.col("tf") * (F.log((F.lit(1.0 + n_comm)) / (F.lit(1.0) + F.col("df")))
                                                  + F.lit(1.0))))
    w = Window.partitionBy("community").orderBy(F.col("tfidf").desc(), F.col("term").asc())
    return (scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.lit(n))
            .select("community", F.col("rank").cast("int").alias("rank"), "term", "tf",
                    F.col("df").cast("long").alias("df"), "tfidf"))
