"""Connected components of an undirected edge table by alternating star steps.

Each step is a group and a join on the edge table; the table is written to
the shared checkpoint folder after each round, so a lost executor never
replays earlier rounds and nothing but two numbers a round reaches the
driver. Hot nodes are partial minima on one side and a join that AQE can
split on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semweave.session import drop_materialized, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each node to its least neighbour."""
    if large:
        both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                             F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"),
                                                                F.least("u", "m").alias("m"))
    j = both.join(least, both["u"] == least["_u"])
    if large:
        out = j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                        F.struct(F.col("u").alias("a"), F.col("m").alias("b")))))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component: its least reachable node."""
    measures = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, seen = materialize(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
                            .where("a <> b").distinct(), "cc", observe=measures)
    while seen["n"]:
        before = seen
        step = materialize(_star(now, large=True), "cc")
        drop_materialized(now)
        now, seen = materialize(_star(step, large=False), "cc", observe=measures)
        drop_materialized(step)
        if seen == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
