"""Distributed Louvain community detection on undirected weighted graphs.

The graph never leaves the cluster: each local-moving round is a handful of
joins and aggregations over the arc list and the node state, and each
level ends with a contraction (``groupBy`` of community pairs). Several
graphs (for instance one per threshold of a sweep) can be clustered in the
same job by naming a ``graph_col``: every table is keyed by
``(graph, node)`` and the graphs advance through the same rounds, so a
sweep over five thresholds costs about as many Spark jobs as one graph.

Local moving in blocks
    Nodes are dealt into blocks of about ``BLOCK_ARCS`` arcs by a hash that is
    drawn anew on every level. The arcs are written once per level, bucketed
    by block, and stay where they lie: a round joins the node state with the
    community totals, sends every block the state of its nodes and of the
    outside nodes they touch, and moves the nodes of a block one after another
    until none gains (``local_moves``). Two blocks may move neighbours at
    once on what they knew before; so a *sweep* is two rounds, each moves one
    half of the nodes, drawn anew every sweep. One block alone needs no halves.
    A node moves to the neighbouring community of largest gain

        gain(c) = w(u, c∖u) / m − k_u · Σtot(c∖u) / (2 m²)

    (ties to the smaller label) only if it beats staying by more than 1e-12;
    beside other blocks a singleton joins another singleton only if that label
    is smaller. Nodes with more than ``hub_arcs`` arcs lie in no block: their
    candidates are aggregated in SQL (partial sums per task), so no arc list is
    gathered whatever a node's degree. The first round of a sweep also adds up
    the modularity of the state it starts from. A graph's level ends after a
    sweep without moves or without a modularity gain above ``tol``; the best
    state seen at a sweep end is kept.

Contraction
    Communities become nodes; parallel edges are summed and internal
    weight becomes a self-loop (counted twice in the degree). Levels repeat
    until a level merges nothing or gains no more than ``threshold``.

Fault tolerance
    The state of every round and the edge list of every level are written
    as Parquet under the folder named by ``spark.checkpoint.dir`` (reliable,
    shared storage) and read back, which cuts the lineage like
    ``checkpoint()``: a lost executor costs a recomputation of one round,
    plans do not grow with the round count, and the re-read tables keep
    true size statistics for the optimizer. Superseded round states are
    deleted as the job advances.

Only per-graph scalars (total weight, modularity, move counts) reach the
driver; their number is the number of graphs.

Result: ``(partition, summary)``. Partition is ``([graph,] node,
community)`` for every node (isolated nodes are singletons), labelled by
the smallest member id; summary has one row per graph ``([graph,]
modularity, num_communities, num_nontrivial, edges, nodes, levels,
rounds)``. A graph without edges gets modularity null, 0 communities and
no partition rows, as in the reference.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semweave.operators.local_moves import move_kernel
from semweave.session import (bucket_labels, drop_materialized, ensure_checkpoint_dir, materialize, materialize_bucketed,
                              ship_package)

_EPS = 1e-12
BLOCK_ARCS = 200_000  # arcs that a block of nodes holds


_VIEW_IDS = itertools.count()


def _sql_lit(v) -> str:
    """A SQL literal for a graph key or a double (exact round trip)."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"CAST({v} AS BIGINT)"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in_list(vals) -> str:
    return "(" + ", ".join(_sql_lit(v) for v in vals) + ")" if vals else "(NULL)"


def _view(df: DataFrame, name: str) -> str:
    """Register ``df`` under a fresh temporary view name."""
    v = f"_sw_{name}_{next(_VIEW_IDS)}"
    df.createOrReplaceTempView(v)
    return v


def _drop_views(spark, *names: str) -> None:
    for n in names:
        spark.catalog.dropTempView(n)


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the graph: a merge, so that neither passes through the driver as a broadcast.

    Every round joins anew; tables just below the broadcast limit would reach
    the driver in each of them.
    """
    return left.join(right.hint("merge"), on, how)


def _hub_round(state: DataFrame, arcs: DataFrame, m: dict, active: list, improved: list,
               level: int, sweep: int, parity: int, seed: int) -> DataFrame:
    """One local-moving round for the eligible half of the hubs (``blk < 0``) of the active graphs.

    A hub has more arcs than a block may hold, so its candidates are
    aggregated, never gathered. Returns the hubs' new state ``(g, node, comm,
    prev, best, k, blk)`` with ``moved``, ``own_w`` (weight into the incoming
    community) and ``own_t`` (degree times the community's total). ``prev`` is the assignment at the start of the
    sweep; ``best`` becomes ``prev`` for the graphs in ``improved``. The first
    round of a sweep looks at all nodes, so its ``own_*`` sums give the
    modularity of the incoming state without a job of its own. The round is
    one SQL statement, so the driver analyses its plan once.
    """
    spark = state.sparkSession
    st, ar = _view(state, "state"), _view(arcs, "arcs")
    act = _in_list(active)
    mmap = "map(" + ", ".join(f"{_sql_lit(g)}, {_sql_lit(float(v))}" for g, v in m.items()) + ")"

    def elig(g, node):
        # a string as salt stays out of the generated code, so all sweeps run the same compiled code
        return f"pmod(xxhash64({g}, {node}, '{int(level)}/{int(sweep)}/{int(seed)}'), 2) = {int(parity)}"

    def looked_at(g, node):
        return "true" if parity == 0 else elig(g, node)

    keep = f"CASE WHEN g IN {_in_list(improved)} THEN prev ELSE best END" if improved else "best"
    out = spark.sql(f"""
        WITH st AS (SELECT g, node, comm, prev, best, k, blk FROM {st} WHERE g IN {act}),
        w_uc AS (
          SELECT /*+ MERGE(n) */ a.g, a.u, n.comm AS cv, a.w, a.k, false AS own, CAST(NULL AS BIGINT) AS prev,
                 CAST(NULL AS BIGINT) AS best
          FROM {ar} a JOIN st n ON n.g = a.g AND n.node = a.v
          WHERE a.g IN {act} AND {looked_at('a.g', 'a.u')}
          UNION ALL
          SELECT g, node AS u, comm AS cv, CAST(0.0 AS DOUBLE) AS w, k, true AS own, prev, best
          FROM st WHERE blk < 0 AND {looked_at('g', 'node')}),
        cand AS (SELECT g, u, cv, sum(w) AS wuc, max(k) AS ku, max(own) AS own, max(prev) AS prev, max(best) AS best
                 FROM w_uc GROUP BY g, u, cv),
        tot AS (SELECT g, comm, sum(k) AS tot, count(1) AS size FROM st GROUP BY g, comm),
        scored AS (
          SELECT /*+ MERGE(t) */ c.*, t.tot, t.size,
                 c.wuc / element_at({mmap}, c.g)
                   - c.ku * (t.tot - CASE WHEN c.own THEN c.ku ELSE 0.0 END)
                     / (2.0 * element_at({mmap}, c.g) * element_at({mmap}, c.g)) AS gain
          FROM cand c JOIN tot t ON t.g = c.g AND t.comm = c.cv),
        pick AS (
          SELECT g, u,
                 max_by(named_struct('c', cv, 'gn', gain, 's', size),
                        named_struct('gain', gain, 'neg_c', -cv)) AS b,
                 max(CASE WHEN own THEN named_struct('gn', gain, 's', size, 'c', cv, 'w', wuc, 't', tot) END) AS o,
                 max(ku) AS k, max(prev) AS prev, max(best) AS best
          FROM scored GROUP BY g, u),
        dec AS (
          SELECT *, ({elig('g', 'u')} AND b.c <> o.c AND b.gn > o.gn + {_EPS!r}
                     AND NOT (o.s = 1 AND b.s = 1 AND b.c > o.c)) AS moved
          FROM pick)
        SELECT g, u AS node, CASE WHEN moved THEN b.c ELSE o.c END AS comm,
               {'o.c' if parity == 0 else 'prev'} AS prev, {keep} AS best, k, CAST(-1 AS BIGINT) AS blk, moved, o.w AS own_w, k * o.t AS own_t
        FROM dec
        UNION ALL
        SELECT g, node, comm, prev, {keep} AS best, k, blk, false AS moved, CAST(0.0 AS DOUBLE) AS own_w,
               CAST(0.0 AS DOUBLE) AS own_t
        FROM st WHERE blk < 0 AND NOT {looked_at('g', 'node')}
    """)
    _drop_views(spark, st, ar)
    return out


def _block_round(state: DataFrame, arcs: DataFrame, copies: DataFrame | None, m: dict, active: list, improved: list,
                 level: int, sweep: int, parity: int, seed: int) -> DataFrame:
    """One local-moving round of all blocks.

    The arcs lie bucketed by block and are not moved; every block gets the
    state of its nodes and of the outside nodes it touches (``copies``; None
    where one block holds everything).
    """
    st = state.where(F.col("g").isin(active))
    tot = st.groupBy("g", "comm").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
    st = _join(st, tot, ["g", "comm"]).select("blk", "g", "node", "comm", "prev", "best", "k", "tot", "size")
    nodes = st.where("blk >= 0").withColumn("own", F.lit(True))
    if copies is not None:
        seen = _join(st.drop("blk"), copies, ["g", "node"]).select(nodes.columns[:-1]).withColumn("own", F.lit(False))
        nodes = nodes.unionByName(seen)
    salt = (seed * 1_000_003 + level) * 1_000_003 + sweep
    kernel = move_kernel(m, improved, parity, salt, copies is None)
    g = state.schema["g"].dataType.simpleString()
    return arcs.groupBy("blk").cogroup(nodes.groupBy("blk")).applyInArrow(
        kernel, f"g {g}, node long, comm long, prev long, best long, k double, blk long, moved boolean, "
                "own_w double, own_t double")


def _written(out: DataFrame, active: list) -> tuple[DataFrame, dict]:
    """The written state of a round, and moves, ``own_w`` and ``own_t`` added up for every active graph.

    The sums are read from the written rows: observed during the write, every
    task would send the driver the aggregates' expressions for all graphs.
    """
    state = materialize(out, "state")
    rows = (state.where(F.col("g").isin(active)).groupBy("g")
            .agg(F.count_if("moved"), F.sum("own_w"), F.sum("own_t")).collect())
    return state.drop("moved", "own_w", "own_t"), {r[0]: (int(r[1]), r[2] or 0.0, r[3] or 0.0) for r in rows}


def louvain(edges: DataFrame, nodes: DataFrame | None = None, *, graph_col: str | None = None,
            graph_ids: list | None = None, seed: int = 42, max_rounds: int | None = None, max_levels: int | None = None,
            threshold: float = 1e-7, tol: float = 1e-6,
            weight_col: str = "weight", order_col: str | None = None, block_arcs: int = BLOCK_ARCS,
            hub_arcs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Louvain communities of ``edges(src, dst, weight[, graph])``.

    ``nodes(node)`` declares the node set (shared by all graphs); nodes
    without edges become singletons. ``graph_ids`` lists the graphs to
    report, including edge-less ones; by default the graphs present in the
    edge table. A graph's level ends when a sweep makes no move or gains
    no more than ``tol`` modularity over the best state so far; levels stop
    when one gains no more than ``threshold``. Of parallel edges the one with
    the largest ``order_col`` counts (without it, the largest weight), as in
    ``graph.normalise_edges``. ``max_rounds`` (per level) and
    ``max_levels`` end the search earlier if set; ``converged`` in the summary
    is false for the graphs they cut short. ``block_arcs`` is the size of a
    block; nodes with more than ``hub_arcs`` arcs (a quarter of a block by
    default) are hubs.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    hub_arcs = max(1, block_arcs // 4) if hub_arcs is None else hub_arcs
    gcol = F.col(graph_col) if graph_col else F.lit(0).cast("long")
    w = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col in edges.columns else F.lit(1.0)
    e = (edges.select(gcol.alias("g"), F.col("src").cast("long").alias("src"),
                      F.col("dst").cast("long").alias("dst"), w.alias("w"),
                      (F.struct(F.col(order_col), w) if order_col else w).alias("_o"))
         .filter(F.col("w") > 0)  # Louvain needs positive weights
         .groupBy("g", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
         .agg(F.max_by("w", "_o").alias("w")))
    level_edges = materialize(e, "edges")
    per_g = level_edges.groupBy("g").agg(F.sum("w").alias("m"), F.count(F.lit(1)).alias("n_e")).collect()
    m = {r["g"]: float(r["m"]) for r in per_g}
    n_edges = {r["g"]: int(r["n_e"]) for r in per_g}
    if graph_ids is None:
        graph_ids = sorted(m) if graph_col else [0]
    gtype = edges.schema[graph_col].dataType if graph_col else T.LongType()

    ends = level_edges.select("g", F.explode(F.array("a", "b")).alias("node"))
    if nodes is not None:
        decl = nodes.select(F.explode(F.array(*[F.lit(x).cast(gtype) for x in graph_ids])).alias("g"),
                            F.col("node").cast("long").alias("node"))
        ends = decl.unionByName(ends)
    all_nodes = materialize(ends.distinct(), "nodes")

    assign = None
    final_q: dict = {}
    levels = {g: 0 for g in m}
    rounds = {g: 0 for g in m}
    running = sorted(m)
    arcs = state = copies = None
    cut: set = set()  # graphs that a bound stopped
    for level in itertools.count():
        if not running:
            break
        if max_levels is not None and level >= max_levels:
            cut |= set(running)
            break
        level_edges = level_edges.filter(F.col("g").isin(running))
        loop = F.col("a") == F.col("b")
        loops = {r["g"]: (float(r["l"] or 0.0), int(r["n"])) for r in level_edges.groupBy("g").agg(
            F.sum(F.when(loop, F.col("w"))).alias("l"), F.count_if(~loop).alias("n")).collect()}
        # both directions of every non-loop edge, from one pass over the edges
        both = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                       F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        # weighted degree: a self-loop counts twice (both of its endpoints)
        other = (F.col("a") != F.col("b")).cast("long").alias("arc")
        k = (level_edges.select("g", F.explode(F.array("a", "b")).alias("node"), "w", other)
             .groupBy("g", "node").agg(F.sum("w").alias("k"), F.sum("arc").alias("arcs")))
        blocks = max(1, math.ceil(2 * sum(loops[g][1] for g in running) / block_arcs))
        blk = F.pmod(F.xxhash64("g", "node", F.lit(level)), F.lit(blocks))
        labels = bucket_labels(spark, blocks + 1)
        if labels[-1] != blocks - 1:  # numbers that each have a bucket of the arcs for themselves
            blk = F.element_at(F.array(*[F.lit(x).cast("long") for x in labels]), (blk + 1).cast("int"))
        blk = F.when(F.col("arcs") > hub_arcs, F.lit(-1)).otherwise(blk)
        state, seen = materialize(
            k.select("g", "node", F.col("node").alias("comm"), F.col("node").alias("prev"), F.col("node").alias("best"),
                     "k", blk.cast("long").alias("blk")), "state", observe={"hubs": F.count_if(F.col("blk") < 0)})
        hubs = int(seen.get("hubs") or 0)
        placed = _join(level_edges.filter(F.col("a") != F.col("b")).select("g", F.inline(both), "w"),
                       state.select("g", F.col("node").alias("u"), "k", "blk"), ["g", "u"])
        arcs = materialize_bucketed(placed.select("blk", "g", "u", "v", "w", "k"), "blk", "arcs", blocks + 1)
        small = arcs.where("blk >= 0") if hubs else arcs
        copies = None
        if blocks > 1 or hubs:
            touched = small.select("blk", "g", F.col("v").alias("node")).distinct()
            home = state.select("g", "node", F.col("blk").alias("home"))
            copies = materialize(_join(touched, home, ["g", "node"]).where("blk <> home").select("blk", "g", "node"), "copies")
        if assign is None:  # identity map, read from the level-0 edge table
            assign = k.select("g", "node", F.col("node").alias("comm"))
        best_q = dict(final_q)  # contraction preserves modularity: a level starts where the last ended
        active = list(running)
        improved: list = []  # graphs whose state at the start of the sweep is their best so far
        sweep_moves: dict = {}
        for r in itertools.count():
            over = max_rounds is not None and r >= max_rounds
            if over and r % 2 == 1:
                cut |= set(active)
                break
            prev = state
            if copies is None and r % 2 == 1:  # the one block has moved all its nodes in the first half already
                seen = {}
            else:
                step = (m, active, improved, level, r // 2, r % 2, seed)
                out = _block_round(prev, small, copies, *step)
                if hubs:
                    out = out.unionByName(_hub_round(prev, arcs.where("blk < 0"), *step))
                idle = prev.where(~F.col("g").isin(active))
                if improved:
                    idle = idle.withColumn("best", F.when(F.col("g").isin(improved), F.col("prev")).otherwise(F.col("best")))
                if len(active) < len(running):
                    out = out.unionByName(idle.select("*", F.lit(False).alias("moved"), F.lit(0.0).alias("own_w"),
                                                      F.lit(0.0).alias("own_t")))
                state, seen = _written(out, active)
                drop_materialized(prev)
            moved = {g: seen[g][0] if g in seen else 0 for g in active}
            for g in active:
                rounds[g] += not over
            if r % 2 == 0:
                sums = {g: seen[g][1:] if g in seen else (0.0, 0.0) for g in active}
                q = {g: (sums[g][0] / 2 + loops[g][0]) / m[g] - sums[g][1] / (4 * m[g] ** 2) for g in active}
                if r == 0:
                    if level == 0:
                        best_q, final_q = dict(q), dict(q)
                else:
                    improved = [g for g in active if q[g] > best_q[g] + 1e-15]
                    # a graph keeps moving while its sweeps still gain more than tol
                    active = [g for g in active if q[g] - best_q[g] > tol]
                    for g in improved:
                        best_q[g] = q[g]
                if over:
                    cut |= set(active)
                    break
                sweep_moves = moved
            else:
                if copies is not None:  # the round has put it into ``best``
                    improved = []
                active = [g for g in active if sweep_moves[g] + moved[g] > 0]
            if not active:
                break
        if improved:  # found in the last round
            state = state.withColumn("best", F.when(F.col("g").isin(improved), F.col("prev")).otherwise(F.col("best")))
        counts = (state.groupBy("g").agg(F.count(F.lit(1)).alias("n"),
                                         F.countDistinct("best").alias("c")).collect())
        merged = []
        for row in counts:
            g = row["g"]
            gained = level == 0 or best_q[g] - final_q[g] > threshold
            if row["c"] < row["n"] and gained:
                merged.append(g)
                final_q[g] = best_q[g]
                levels[g] += 1
        running = sorted(merged)
        if not running:
            break
        mapping = (state.filter(F.col("g").isin(running))
                   .select("g", F.col("node").alias("comm"), F.col("best").alias("new_comm")))
        old_assign, old_edges = assign, level_edges
        assign = materialize(_join(assign, mapping, ["g", "comm"], "left")
                             .select("g", "node", F.coalesce("new_comm", "comm").alias("comm")), "assign")
        c1 = state.select("g", F.col("node").alias("a"), F.col("best").alias("ca"))
        c2 = state.select("g", F.col("node").alias("b"), F.col("best").alias("cb"))
        level_edges = materialize(
            _join(_join(level_edges.filter(F.col("g").isin(running)), c1, ["g", "a"]), c2, ["g", "b"])
            .groupBy("g", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
            .agg(F.sum("w").alias("w")), "edges")
        # superseded level tables (the level-0 identity map reads the old edges)
        for t in (arcs, copies, state, old_edges) + ((old_assign,) if level > 0 else ()):
            if t is not None:
                drop_materialized(t)

    # nodes without edges are their own communities; label = smallest member
    if assign is None:
        assign = spark.createDataFrame([], T.StructType([T.StructField("g", gtype),
                                                          T.StructField("node", T.LongType()),
                                                          T.StructField("comm", T.LongType())]))
    with_edges = all_nodes.filter(F.col("g").isin(list(m))) if m else all_nodes.limit(0)
    full = (_join(with_edges, assign, ["g", "node"], "left")
            .select("g", "node", F.coalesce("comm", -F.col("node") - F.lit(1)).alias("comm")))
    labels = full.groupBy("g", "comm").agg(F.min("node").alias("community"), F.count(F.lit(1)).alias("size"))
    partition = materialize(_join(full, labels, ["g", "comm"]).select("g", "node", "community"), "partition")
    sizes = {r["g"]: r for r in labels.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("size") >= 2).alias("nt")).collect()}
    node_counts = {r["g"]: int(r["count"]) for r in all_nodes.groupBy("g").count().collect()}
    done = [all_nodes, level_edges, arcs, copies, state]
    if levels and max(levels.values(), default=0) > 0:
        done.append(assign)
    for t in done:
        if t is not None:
            drop_materialized(t)
    rows = []
    for g in graph_ids:
        if g in m:
            rows.append((g, float(final_q[g]), int(sizes[g]["n"]), int(sizes[g]["nt"]), n_edges[g],
                         node_counts.get(g, 0), levels[g], rounds[g], g not in cut))
        else:
            rows.append((g, None, 0, 0, 0, node_counts.get(g, 0), 0, 0, True))
    schema = T.StructType([
        T.StructField("g", gtype), T.StructField("modularity", T.DoubleType()),
        T.StructField("num_communities", T.LongType()), T.StructField("num_nontrivial", T.LongType()),
        T.StructField("edges", T.LongType()), T.StructField("nodes", T.LongType()),
        T.StructField("levels", T.IntegerType()), T.StructField("rounds", T.IntegerType()),
        T.StructField("converged", T.BooleanType())])
    summary = spark.createDataFrame(rows, schema)
    if graph_col:
        return (partition.withColumnRenamed("g", graph_col), summary.withColumnRenamed("g", graph_col))
    return partition.drop("g"), summary.drop("g")
