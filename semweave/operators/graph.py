"""Thresholded similarity graphs and their statistics.

Edges are ``(src, dst, dist, weight)`` with ``src < dst`` and
``weight = 1 - dist``; nodes are an explicit ``(node)`` table so isolated
nodes are never lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.functions.text import clean_title, tau_tag, unknown_title


def similarity_graph(knn: DataFrame, tau: float, symmetry: str = "forward",
                     keep_rank: bool = False) -> DataFrame:
    """Edges with ``dist <= tau`` from a kNN table.

    ``forward`` (reference): edge (a, b), a < b, only if b is among a's
    neighbours. ``union``: either direction. ``mutual``: both directions.
    Union and mutual group on the unordered pair (one shuffle). With
    ``keep_rank`` the forward edges keep the neighbour rank (file order of
    the reference edge list is ``(src, rank)``).
    """
    near = knn.filter(F.col("dist") <= F.lit(float(tau)))
    if symmetry == "forward":
        cols = ["src", "dst", "dist"] + (["rank"] if keep_rank else [])
        e = near.filter(F.col("src") < F.col("dst")).select(*cols)
    elif symmetry in ("union", "mutual"):
        g = (near.filter(F.col("src") != F.col("dst"))
             .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
             .agg(F.min("dist").alias("dist"), F.count(F.lit(1)).alias("_n")))
        if symmetry == "mutual":
            g = g.filter(F.col("_n") >= 2)
        e = g.select("src", "dst", "dist")
    else:
        raise ValueError(f"unknown symmetry {symmetry!r}")
    return e.withColumn("weight", F.lit(1.0) - F.col("dist"))


def normalise_edges(edges: DataFrame, order_col: str | None = None) -> DataFrame:
    """Collapse parallel/reversed edges to one per unordered pair.

    The reference graph loader keeps the last of duplicate edges; with
    ``order_col`` the row with the largest value of it wins, otherwise the
    largest weight. A missing weight counts as 1.0.
    """
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    key = F.struct(F.col(order_col), w) if order_col else w
    return (edges.withColumn("weight", w)
            .groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .agg(F.max_by(F.struct("dist", "weight"), key).alias("_e"))
            .select("src", "dst", "_e.dist", "_e.weight"))


def endpoints(edges: DataFrame, with_weight: bool = False) -> DataFrame:
    """Both endpoints of every edge: ``(node[, weight])``, from a single
    pass over the edges (one row becomes two through ``inline``)."""
    if with_weight:
        pair = F.array(F.struct(F.col("src").alias("node"), F.col("weight").alias("weight")),
                       F.struct(F.col("dst").alias("node"), F.col("weight").alias("weight")))
        return edges.select(F.inline(pair))
    return edges.select(F.explode(F.array("src", "dst")).alias("node"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)`` for nodes with at least one edge."""
    return endpoints(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared nodes that no edge touches."""
    return nodes.select("node").join(endpoints(edges).select("node"), "node", "left_anti")


def _stats_from_per_node(per_node: DataFrame, group_cols: list[str]) -> DataFrame:
    deg = F.col("degree")
    agg = per_node.groupBy(*group_cols) if group_cols else per_node
    out = agg.agg(
        F.sum("declared").cast("long").alias("nodes"),
        (F.sum(deg) / 2).cast("long").alias("edges"),
        F.coalesce(F.percentile(F.when(deg > 0, deg), 0.5), F.lit(0.0)).cast("double")
        .alias("median_degree"),
        F.count_if(deg > 0).alias("_touched"),
    )
    return (out.withColumn("avg_degree", (F.lit(2.0) * F.col("edges"))
                           / F.greatest(F.col("nodes"), F.lit(1)).cast("double"))
            .withColumn("isolated_nodes", (F.col("nodes") - F.col("_touched")).cast("long"))
            .select(*group_cols, "nodes", "edges", "avg_degree", "median_degree", "isolated_nodes"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(nodes, edges, avg_degree, median_degree, isolated_nodes)``.

    ``avg_degree = 2E / max(N, 1)``; the median is over nodes with at least
    one edge (0.0 when there are none); ``isolated = N - touched``.
    Declared nodes and edge endpoints are combined in one aggregation keyed
    by node (one shuffle), followed by a global aggregate; the median is
    over integer degrees, whose distinct values are few.
    """
    decl = nodes.select("node", F.lit(1).alias("declared"), F.lit(0).alias("d"))
    ends = endpoints(edges).select("node", F.lit(0).alias("declared"), F.lit(1).alias("d"))
    per_node = (decl.unionByName(ends).groupBy("node")
                .agg(F.max("declared").alias("declared"), F.sum("d").alias("degree")))
    return _stats_from_per_node(per_node, [])


def graph_sweep(knn: DataFrame, nodes: DataFrame, taus: DataFrame, symmetry: str = "forward") -> DataFrame:
    """Graph statistics for several thresholds from one kNN table.

    ``taus(p_keep, tau[, tau_tag])`` is small (one row per candidate) and
    is read once to the driver; each kNN row is expanded to the thresholds
    it passes (``dist <= tau``) with an array filter, so no join against
    the threshold table is needed and the kNN is scanned once.
    """
    rows = taus.select("p_keep", "tau").collect()  # bounded by the candidate list
    if not rows:
        raise ValueError("empty threshold table")
    tlist = sorted({float(r["tau"]) for r in rows})
    arr = F.array(*[F.lit(t) for t in tlist])
    if symmetry == "forward":
        base = knn.filter(F.col("src") < F.col("dst")).select("src", "dst", "dist")
    else:
        g = (knn.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
             .agg(F.min("dist").alias("dist"), F.count(F.lit(1)).alias("_n")))
        if symmetry == "mutual":
            g = g.filter(F.col("_n") >= 2)
        base = g.select("src", "dst", "dist")
    e = (base.filter(F.col("dist") <= F.lit(tlist[-1]))
         .select("src", "dst", F.explode(F.filter(arr, lambda t: F.col("dist") <= t)).alias("tau")))
    ends = e.select("tau", F.explode(F.array("src", "dst")).alias("node"))
    per = ends.groupBy("tau", "node").agg(F.count(F.lit(1)).alias("degree"))
    n_nodes = nodes.count()
    stats = (per.groupBy("tau").agg(
        (F.sum("degree") / 2).cast("long").alias("edges"),
        F.percentile("degree", 0.5).cast("double").alias("median_degree"),
        F.count(F.lit(1)).alias("_touched")))
    t = taus.select("p_keep", "tau")
    out = t.join(F.broadcast(stats), "tau", "left")  # one row per candidate τ: bounded
    return out.select(
        "p_keep", "tau", tau_tag(F.col("tau")).alias("tau_tag"),
        F.lit(n_nodes).cast("long").alias("nodes"),
        F.coalesce(F.col("edges"), F.lit(0)).cast("long").alias("edges"),
        (F.lit(2.0) * F.coalesce(F.col("edges"), F.lit(0)) / F.lit(max(n_nodes, 1))).alias("avg_degree"),
        F.coalesce(F.col("median_degree"), F.lit(0.0)).alias("median_degree"),
        (F.lit(n_nodes) - F.coalesce(F.col("_touched"), F.lit(0))).cast("long").alias("isolated_nodes"),
    )


def edge_title_sample(edges: DataFrame, papers: DataFrame, n: int = 2000,
                      id_col: str = "paper_id", title_col: str = "title",
                      order: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """First ``n`` edges in ``order`` with both cleaned titles.

    ``orderBy().limit()`` becomes a top-n (``TakeOrderedAndProject``); the
    two metadata look-ups are left joins on the id after the cut. An id
    without metadata gets the title ``<unknown {id}>``.
    """
    first = edges.orderBy(*order).limit(n)
    meta = papers.select(F.col(id_col).alias("_id"), clean_title(F.col(title_col)).alias("_t"))
    j = (first.join(meta.withColumnRenamed("_t", "title1"), first["src"] == F.col("_id"), "left")
         .drop("_id"))
    j = j.join(meta.withColumnRenamed("_t", "title2"), j["dst"] == F.col("_id"), "left").drop("_id")
    # a missing title is '' (clean_title); a missing metadata row is "<unknown id>"
    return j.select("src", "dst",
                    F.coalesce("title1", unknown_title(F.col("src"))).alias("title1"),
                    F.coalesce("title2", unknown_title(F.col("dst"))).alias("title2"), "dist", "weight")
