from pyspark.sql import functions as F

from semweave.operators import distance as D
from semweave.operators import graph as G
from semweave.operators.knn import knn_join
from semweave.sources import tables as TB
from tests.conftest import SF001


def _edges(spark, rows):
    return spark.createDataFrame([(a, b, 1.0 - w, w) for a, b, w in rows],
                                 "src long, dst long, dist double, weight double")


def _nodes(spark, n):
    return spark.range(n).select(F.col("id").alias("node"))


def test_no_edges(spark):
    s = G.graph_stats(_nodes(spark, 5), _edges(spark, []).filter("false")).first()
    assert (s["nodes"], s["edges"], s["avg_degree"], s["median_degree"], s["isolated_nodes"]) == (5, 0, 0.0, 0.0, 5)
    s0 = G.graph_stats(_nodes(spark, 0), _edges(spark, []).filter("false")).first()
    assert s0 is None or s0["avg_degree"] in (0.0, None)


def test_path_plus_isolated(spark):
    s = G.graph_stats(_nodes(spark, 4), _edges(spark, [(0, 1, 1.0), (1, 2, 1.0)])).first()
    assert (s["edges"], s["avg_degree"], s["median_degree"], s["isolated_nodes"]) == (2, 1.0, 1.0, 1)
    iso = [r[0] for r in G.isolated_nodes(_nodes(spark, 4), _edges(spark, [(0, 1, 1.0), (1, 2, 1.0)])).collect()]
    assert iso == [3]


def test_symmetry_modes(spark):
    knn = spark.createDataFrame([(0, 1, 1, 0.1), (1, 0, 1, 0.1), (2, 0, 1, 0.2), (0, 2, 2, 0.2), (3, 1, 1, 0.3)],
                                "src long, dst long, rank int, dist double")
    # 3 -> 1 only from the larger id: forward drops it, union keeps it
    f = {(r.src, r.dst) for r in G.similarity_graph(knn, 0.5, "forward").collect()}
    u = {(r.src, r.dst) for r in G.similarity_graph(knn, 0.5, "union").collect()}
    m = {(r.src, r.dst) for r in G.similarity_graph(knn, 0.5, "mutual").collect()}
    assert f == {(0, 1), (0, 2)}
    assert u == {(0, 1), (0, 2), (1, 3)}
    assert m == {(0, 1), (0, 2)}
    assert m <= f <= u


def test_sweep_matches_single_graphs_and_golden(spark):
    v = TB.vectors_from_embeddings(TB.load_table(spark, SF001, "embeddings"))
    nodes = TB.node_table(v)
    knn = knn_join(v, 49).cache()
    taus = D.tau_candidates(D.distance_histogram(knn))
    sweep = G.graph_sweep(knn, nodes, taus).orderBy("p_keep").collect()
    assert [r["edges"] for r in sweep] == [66, 149, 189, 257, 332]
    assert [r["isolated_nodes"] for r in sweep] == [388, 290, 248, 192, 142]
    assert [r["median_degree"] for r in sweep] == [1.0, 1.0, 1.0, 1.0, 2.0]
    for r in sweep:
        s = G.graph_stats(nodes, G.similarity_graph(knn, r["tau"])).first()
        assert (s["edges"], s["isolated_nodes"], s["median_degree"]) == (r["edges"], r["isolated_nodes"], r["median_degree"])
        assert abs(s["avg_degree"] - r["avg_degree"]) < 1e-12
    deg = G.degrees(G.similarity_graph(knn, sweep[3]["tau"]))
    assert deg.agg(F.sum("degree")).first()[0] == 2 * 257


def test_symmetry_golden_k5(spark):
    v = TB.vectors_from_embeddings(TB.load_table(spark, SF001, "embeddings"))
    knn = knn_join(v, 5).cache()
    counts = [G.similarity_graph(knn, 0.66, m).count() for m in ("forward", "union", "mutual")]
    assert counts == [330, 332, 330]


def test_normalise_edges(spark):
    e = spark.createDataFrame([(1, 0, 0.5, None), (0, 1, 0.2, 0.8), (2, 3, 0.1, 0.9)],
                              "src long, dst long, dist double, weight double")
    out = {(r.src, r.dst): r.weight for r in G.normalise_edges(e).collect()}
    assert out == {(0, 1): 1.0, (2, 3): 0.9}


def test_edge_title_sample(spark):
    e = _edges(spark, [(0, 1, 0.9), (0, 2, 0.8), (1, 2, 0.7)])
    papers = spark.createDataFrame([(0, "a\tb"), (1, " c\n"), (2, None)], "paper_id long, title string")
    rows = G.edge_title_sample(e, papers, n=2).collect()
    assert [(r.title1, r.title2) for r in rows] == [("a b", "c"), ("a b", "")]


def test_sweep_threshold_without_edges(spark):
    v = TB.vectors_from_embeddings(TB.load_table(spark, SF001, "embeddings"))
    knn = knn_join(v, 5)
    taus = spark.createDataFrame([(0.01, 0.0), (0.2, 0.66)], "p_keep double, tau double")
    rows = {r.p_keep: r for r in G.graph_sweep(knn, TB.node_table(v), taus).collect()}
    assert (rows[0.01].edges, rows[0.01].isolated_nodes, rows[0.01].median_degree) == (0, 500, 0.0)
    assert rows[0.2].edges == 330
