import pytest
from pyspark.sql import functions as F

from semweave.operators import community as C
from semweave.operators.louvain import louvain
from semweave.sources import tables as TB
from tests.conftest import SF001, SF01


def _edges(spark, pairs, w=1.0):
    return spark.createDataFrame([(a, b, 0.0, w) for a, b in pairs], "src long, dst long, dist double, weight double")


def _nodes(spark, n):
    return spark.range(n).select(F.col("id").alias("node"))


def _ring_of_cliques(n_cliques=30, size=6):
    pairs = []
    for c in range(n_cliques):
        base = c * size
        pairs += [(base + i, base + j) for i in range(size) for j in range(i + 1, size)]
        pairs.append((base, ((c + 1) % n_cliques) * size + 1))
    return pairs


def test_two_triangles_modularity_and_louvain(spark):
    e = _edges(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)])
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3), (6, 6)], "node long, community long")
    assert C.modularity(e, part).first()["modularity"] == pytest.approx(0.5)
    p, s = louvain(e, _nodes(spark, 7))
    row = s.first()
    assert row["num_communities"] == 3 and row["modularity"] == pytest.approx(0.5)
    got = {r.node: r.community for r in p.collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}


def test_ring_of_cliques(spark):
    e = _edges(spark, _ring_of_cliques())
    p, s = louvain(e, _nodes(spark, 180))
    row = s.first()
    assert row["num_communities"] == 30
    assert row["modularity"] == pytest.approx(0.9042, abs=5e-4)
    assert C.modularity(e, p).first()["modularity"] == pytest.approx(row["modularity"], abs=1e-9)
    assert p.count() == 180 and p.select("node").distinct().count() == 180


def test_zero_edges(spark):
    e = _edges(spark, []).filter("false")
    p, s = louvain(e, _nodes(spark, 5))
    row = s.first()
    assert row["modularity"] is None and row["num_communities"] == 0 and p.count() == 0
    assert C.modularity(e, spark.createDataFrame([(0, 0)], "node long, community long")).first()["modularity"] is None


def test_duplicates_oracle(spark):
    docs = TB.load_table(spark, SF001, "documents")
    p, s = louvain(TB.duplicate_edges(docs), docs.select(F.col("doc_id").alias("node")))
    oracle = docs.selectExpr("doc_id as node", "min(doc_id) over (partition by text) as community")
    assert p.exceptAll(oracle).count() == 0 and oracle.exceptAll(p).count() == 0


def test_batched_graphs_match_shapes(spark):
    tri = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    e1 = _edges(spark, tri).withColumn("g", F.lit("a"))
    e2 = _edges(spark, _ring_of_cliques(6, 4)).withColumn("g", F.lit("b"))
    p, s = louvain(e1.unionByName(e2), _nodes(spark, 24), graph_col="g", graph_ids=["a", "b", "c"])
    rows = {r.g: r for r in s.collect()}
    assert rows["a"]["modularity"] == pytest.approx(0.5)
    assert rows["a"]["num_communities"] == 20  # 2 triangles + 18 isolated declared nodes
    assert rows["b"]["num_communities"] == 6
    assert rows["c"]["modularity"] is None and rows["c"]["num_communities"] == 0
    assert p.filter("g = 'a'").count() == 24


def test_label_partition_measures(spark):
    from semweave.operators import distance as D, graph as G
    from semweave.operators.knn import knn_join

    e = TB.load_table(spark, SF01, "embeddings")
    v = TB.vectors_from_embeddings(e)
    knn = knn_join(v, 49).cache()
    tau = D.choose_tau(D.distance_histogram(knn), 0.2)
    g = G.similarity_graph(knn, tau)
    part = TB.label_partition(e)
    assert C.modularity(g, part).first()["modularity"] == pytest.approx(-0.005948, abs=1e-6)
    coh = C.coherence(knn, part, 5).filter("is_total").first()
    assert coh["share"] == pytest.approx(0.1044, abs=1e-4)
    sizes = C.community_sizes(part)
    assert sizes.agg(F.sum("size")).first()[0] == 500
    rep = C.community_representative(g, part).collect()
    assert len(rep) == sizes.count()


def test_community_terms(spark):
    docs = spark.createDataFrame([(0, "apple apple banana"), (1, "apple cherry"), (2, "durian durian")],
                                 "paper_id long, abstract string")
    part = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node long, community long")
    rows = C.community_terms(docs, part, n=2).orderBy("community", "rank").collect()
    assert [(r.community, r.term) for r in rows] == [(0, "apple"), (0, "banana"), (1, "durian")]


def test_non_positive_weights_are_dropped(spark):
    e = spark.createDataFrame([(0, 1, 0.1, 0.9), (1, 2, 0.2, 0.8), (0, 2, 0.1, 0.9), (2, 3, 1.3, -0.3),
                               (3, 4, 0.1, 0.9), (4, 5, 0.1, 0.9), (3, 5, 0.1, 0.9)],
                              "src long, dst long, dist double, weight double")
    p, s = louvain(e, _nodes(spark, 6))
    row = s.first()
    assert row["edges"] == 6  # the negative-weight edge is not part of the graph
    got = {r.node: r.community for r in p.collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}



def test_coherence_partial_partition(spark):
    knn = spark.createDataFrame([(0, 1, 1, 0.1), (1, 0, 1, 0.1), (2, 0, 1, 0.2)],
                                "src long, dst long, rank int, dist double")
    part = spark.createDataFrame([(0, 5), (1, 5)], "node long, community long")
    rows = {(r.community, r.is_total): (r.pairs, r.same) for r in C.coherence(knn, part, 5).collect()}
    assert rows == {(5, False): (2, 2), (None, False): (1, 0), (None, True): (3, 2)}


@pytest.mark.parametrize("max_rounds", [1, 2, 3])
def test_bounded_search_reports_the_modularity_of_its_partition(spark, max_rounds):
    e = _edges(spark, [(i, i + 1) for i in range(40)])
    p, s = louvain(e, _nodes(spark, 41), max_rounds=max_rounds)
    row = s.first()
    assert not row["converged"]
    assert row["modularity"] == pytest.approx(C.modularity(e, p).first()["modularity"], abs=1e-9)


def test_self_loops_and_several_graphs(spark):
    rows = [("a", x, y, 1.0) for x, y in [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]]
    rows += [("b", 0, 0, 4.0), ("b", 0, 1, 1.0), ("b", 2, 3, 1.0), ("b", 3, 3, 2.0)]
    e = spark.createDataFrame(rows, "g string, src long, dst long, weight double")
    p, s = louvain(e, _nodes(spark, 6), graph_col="g")
    got = {r["g"]: r for r in s.collect()}
    own = {r["g"]: r for r in C.modularity_by_graph(e, p, "g").collect()}
    for g in ("a", "b"):
        assert got[g]["converged"]
        assert got[g]["modularity"] == pytest.approx(own[g]["modularity"], abs=1e-9)
        assert own[g]["modularity"] == pytest.approx(
            C.modularity(e.filter(F.col("g") == g), p.filter(F.col("g") == g)).first()["modularity"])
    assert {r["node"]: r["community"] for r in p.filter("g = 'a'").collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
