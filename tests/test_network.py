"""Micro fixtures with values worked out by hand, formats, and invariants."""

import math

import numpy as np
import pytest
from laminet.functions import special
from laminet.model import MultilayerNetwork, NetConfig, symmetrize
from laminet.operators import classify, community, hin, iterate, layout, network, rules, stats
from laminet.sources import generators, sinks, text
from laminet.streaming import activity as streaming
from pyspark.sql import functions as F


def edges(spark, rows):
    return spark.createDataFrame([(str(a), str(b), float(w)) for a, b, w in rows], "src string, dst string, weight double")


@pytest.fixture(scope="module")
def multiplex(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("m") / "m.edges"
    p.write_bytes(b"# comment\r\n1 0 1 1\r\n1 1 2 1\n1 1 3 1\n2 0 1 1\n2 1 2 1\n2 0 2 x\n\n")
    return text.load_network(spark, str(p), "multiplex_edges")


def test_aggregate(multiplex):
    got = {(r.src, r.dst): r.weight for r in network.aggregate_edges(multiplex, "raw").collect()}
    assert got == {("0", "1"): 2, ("1", "2"): 2, ("0", "2"): 1, ("1", "3"): 1}
    got = {(r.src, r.dst): round(r.weight, 6) for r in network.aggregate_edges(multiplex).collect()}
    assert got == {("0", "1"): 1.166667, ("1", "2"): 1.166667, ("0", "2"): 0.5, ("1", "3"): 0.666667}
    with pytest.raises(ValueError):
        network.aggregate_edges(multiplex, "betweenness")


def test_coupling(multiplex):
    assert network.coupling_existing(multiplex.nodes).count() == 3
    assert network.coupling_full(multiplex.nodes).count() == 8
    both = network.couple(multiplex)
    assert both.get_edges().count() == 9 and both.get_edges(coupling=False).count() == 6
    a = {(r.i, r.j): r.v for r in network.supra_adjacency(multiplex, coupling=True).collect()}
    assert all(a[j, i] == v for (i, j), v in a.items()) and len(a) == 18


def test_entanglement(spark):
    e = spark.createDataFrame([("1", "A", "2", "A"), ("2", "A", "3", "A"), ("1", "B", "2", "B"), ("3", "B", "4", "B")], "src string, src_layer string, dst string, dst_layer string")
    (block,) = network.entanglement(network.occurrence(e))
    assert block["layers"] == ["A", "B"] and math.isclose(block["intensity"], 0.5) and math.isclose(block["homogeneity"], 1) and math.isclose(block["normalized"], 1, abs_tol=1e-6)


def test_mutation(spark):
    net = network.add_edge_rows(MultilayerNetwork.empty(spark), [{"source": "a", "target": "b", "type": "t", "weight": 2}, ["a", "x", "b", "y", 1], ["a", "x", "b", "y", 3], ["c", "x", "c", "x", 1]])
    assert {(r.src, r.src_layer, r.etype) for r in net.edges.collect()} == {("a", "null", "t"), ("a", "x", "default"), ("c", "x", "default")}
    gone = network.remove_edges(net.edges, net.edges.where("weight = 1 and src = 'a'"))
    assert sorted(r.weight for r in gone.where("src = 'a'").collect()) == [2.0, 3.0]
    less = network.remove_nodes(net, net.nodes.where("node = 'b' and layer = 'y'"))
    assert less.edges.count() == 2
    assert {(r.node, r.degree) for r in network.degrees(net.edges).where("node = 'c'").collect()} == {("c", 2)}
    assert network.isolates(network.add_nodes(net, spark.createDataFrame([("z",)], "node string"))).count() == 1
    assert network.simple_edges(net.edges).count() == 3


def test_ppr_path(spark):
    p = iterate.stochastic(symmetrize(edges(spark, [(1, 2, 1), (2, 3, 1)])))
    seed = spark.createDataFrame([("1", "1")], "seed string, node string")
    three = {r.node: r["rank"] for r in iterate.personalized_pagerank(p, seed, steps=3, zero_seeds=False, unit=False).collect()}
    assert np.allclose([three[k] for k in "123"], [0.2041875, 0.741625, 0.0541875])
    full = {r.node: r["rank"] for r in iterate.personalized_pagerank(p, seed, epsilon=1e-4, zero_seeds=False, unit=False, most=60).collect()}
    assert np.allclose([full[k] for k in "123"], [0.345270, 0.459459, 0.195270], atol=1e-3)


def test_midpoint_weights(spark):
    """Three of five nodes in the class, a midpoint of two points, both in it."""
    labels = spark.createDataFrame([(str(i), "c") for i in range(3)] + [("3", "d"), ("4", "d")], "node string, label string")
    points = spark.createDataFrame([("m", "0"), ("m", "1")], "mid string, point string")

    def one(name):
        tp, fp, fn, tn, n, k = 2.0, 0.0, 1.0, 2.0, 5.0, 2.0
        return spark.range(1).select(hin.HEURISTICS[name](*map(F.lit, (tp, fp, fn, tn, n, k))).alias("w")).first().w

    want = {"chi": 0.444444, "ig": 0.419973, "gr": 0.432538, "idf": 0.510826, "delta": 0.5, "rf": 2.0}
    assert {k: round(one(k), 6) for k in want} == want
    assert hin.midpoint_weights(points, labels, "tf").first().w == 1.0


TRIANGLES = [(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 1)]


def test_two_triangles(spark):
    e = edges(spark, TRIANGLES)
    part = spark.createDataFrame([(str(i), i > 3) for i in range(1, 7)], "node string, community boolean").withColumn("community", F.col("community").cast("long"))
    assert round(community.modularity(e, part).first()[0], 6) == round(community.modularity_louvain(e, part).first()[0], 6) == 0.357143
    code = community.codelength(e, part).first()
    assert round(code.codelength, 6) == 2.320730 and round(code.one_level, 6) == 2.556657
    for found in (community.louvain(e), community.infomap(e)):
        assert {r.node: r.community for r in found.collect()} == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4", "6": "4"}
    levels = community.dendrogram(e)
    top = community.partition_at_level(levels, levels.agg(F.max("level")).first()[0])
    assert top.select("community").distinct().count() == 2
    assert community.multiplex_louvain(e.withColumn("src_layer", F.lit("a"))).select("community").distinct().count() == 2
    assert iterate.triangles(e).count() == 2 and iterate.diameter(e) == 3
    assert {r.node: round(r.value, 4) for r in iterate.betweenness(e).collect()}["3"] == 0.6


def test_label_propagation_and_walks(spark):
    e = edges(spark, TRIANGLES)
    y = spark.createDataFrame([("1", "a", 1.0), ("6", "b", 1.0)], "node string, label string, v double")
    truth = spark.createDataFrame([(str(i), "a" if i < 4 else "b") for i in range(1, 7)], "node string, label string")
    got = iterate.label_propagation(symmetrize(e), y, 0.8, 10)
    assert classify.f1(classify.top_k_labels(got, truth), truth).first().micro == 1.0
    w = spark.createDataFrame([(i, "1") for i in range(20)], "walker long, node string")
    path = iterate.random_walks(e, w, 5).collect()
    assert len(path) == 120
    assert iterate.biased_walks(e, w, 3, 0.5, 2.0).count() == 80
    levels = {r.node: r.level for r in iterate.bfs(e, spark.createDataFrame([("1",)], "node string")).collect()}
    assert levels == {"1": 0, "2": 1, "3": 1, "4": 2, "5": 3, "6": 3}


def test_special_functions():
    assert round(special.fisher_exact(3, 1, 1, 3), 6) == 0.485714
    assert math.isclose(special.zeta(2), math.pi**2 / 6, rel_tol=1e-10)
    assert math.isclose(special.chi2_sf(3.841459, 1), 0.05, rel_tol=1e-5)
    assert math.isclose(special.t_cdf(2.0, 10), 0.963306, rel_tol=1e-5)
    best = special.nelder_mead(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, [0.0, 0.0])
    assert np.allclose(best, [3, -1], atol=1e-3)


def test_powerlaw(spark):
    d = spark.createDataFrame([(x,) for x in (1, 1, 1, 1, 2, 2, 2, 3, 4, 5)], "x int")
    row = stats.powerlaw_alpha(d, "x").where("xmin = 1").first()
    assert round(row.alpha, 6) == 1.763053 and round(row.sigma, 6) == 0.241298
    x = np.array([r.x for r in stats.sample_powerlaw(spark, 2000, 2.5).collect()])
    p, a = stats.fit_family(x, "power_law", 1.0)
    assert abs(p[0] - 2.5) < 0.15
    assert stats.likelihood_ratio(a, stats.fit_family(x, "exponential", 1.0)[1])[0] > 0
    for family in stats.FAMILIES:
        stats.fit_family(np.ceil(x[:200]), family, 1.0)


def test_bayes():
    x = np.random.default_rng(1).normal(0.02, 0.01, 100)
    left, rope, right = stats.correlated_ttest(x, 0.01, 10)
    assert right > 0.8 and math.isclose(left + rope + right, 1)
    assert stats.sign_test(1, 2, 30)[2] > 0.95 and stats.signed_rank(x[:15], 0.001, draws=500)[2] > 0.9


def test_rules(spark):
    sub = spark.createDataFrame([("a", "top"), ("b", "top"), ("a1", "a")], "child string, parent string")
    assert rules.closure(sub).count() == 4 + 4
    with pytest.raises(ValueError):
        rules.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"))
    ex = spark.createDataFrame([(i, "yes" if i < 10 else "no") for i in range(30)], "ex long, label string")
    m = spark.createDataFrame([("a1" if i < 10 else "b", i) for i in range(30)] + [("x", i) for i in range(0, 30, 2)], "pred string, ex long")
    found = rules.run(m, ex, sub, rules.Defaults(depth=2))
    assert found["yes"][0]["tp"] == 10 and found["yes"][0]["p_value"] < 1e-5 and "cov=10" in rules.report(found["yes"], "yes")


def test_formats(spark, tmp_path, multiplex):
    sinks.save_network(multiplex, str(tmp_path / "a"), "multiedgelist")
    back = text.load_network(spark, str(tmp_path / "a"), "multiedgelist")
    key = lambda n: sorted((r.src, r.src_layer, r.dst, r.weight) for r in n.edges.collect())
    assert key(back) == key(multiplex)
    sinks.save_network(multiplex, str(tmp_path / "n"), "native")
    assert key(text.load_network(spark, str(tmp_path / "n"), "native")) == key(multiplex)
    for kind in ("multiedgelist_encoded", "edgelist", "json", "pajek"):
        sinks.save_network(multiplex, str(tmp_path / kind), kind)
    (tmp_path / "g.gml").write_text('graph [ multigraph 1 node [ id 0 label "x" type "A" labels "p---q" ] node [ id 1 label "y" type "B" ] edge [ source 0 target 1 key 0 type "t" ] ]')
    g = text.load_network(spark, str(tmp_path / "g.gml"), "gml")
    assert [(r.src, r.src_layer, r.dst, r.dst_layer, r.etype) for r in g.edges.collect()] == [("x", "A", "y", "B", "t")]
    assert {r.node: r.labels for r in g.nodes.collect()}["x"] == ["p", "q"]
    (tmp_path / "d.json").write_text('{"nodes": [{"id": 1, "label": "a", "descriptors": "l1;l2"}, {"id": 2, "label": "b", "descriptors": "l1"}], "links": [{"source": 1, "target": 2, "descriptors": "l1"}]}')
    assert text.load_network(spark, str(tmp_path / "d.json"), "detangler_json").edges.count() == 2
    (tmp_path / "o.obo").write_text("format-version: 1\n\n[Term]\nid: G:1\nis_a: G:2 ! x\nis_a: G:3\n\n[Term]\nid: G:2\n")
    assert sorted(map(tuple, text.obo(spark, str(tmp_path / "o.obo")).collect())) == [("G:1", "G:2"), ("G:1", "G:3")]
    (tmp_path / "p.net").write_text('*Vertices 2\n1 "a"\n2 "b"\n*Edges 1\n1 2 3.5\n')
    assert [(r.src, r.dst, r.weight) for r in text.load_network(spark, str(tmp_path / "p.net"), "pajek").edges.collect()] == [("a", "b", 3.5)]
    (tmp_path / "e.txt").write_text("1 2 1\n1 2 7\n")
    assert text.load_network(spark, str(tmp_path / "e.txt"), "edgelist").edges.first().weight == 7
    with pytest.raises(ValueError):
        text.load_network(spark, "x", "nothing")


def test_generators(spark):
    assert 20 < generators.random_multilayer_er(spark, 30, 3, 0.1).edges.count() < 80
    assert generators.random_multiplex_er(spark, 20, 2, 0.2, 3).edges.select("src_layer").distinct().count() == 2
    a, b = (sorted(map(str, generators.random_multiplex(spark, 12, 3, 0.8, 5).edges.collect())) for _ in range(2))
    assert a == b and a


def test_layout(spark):
    at = layout.force_layout(edges(spark, TRIANGLES), steps=10).collect()
    assert len(at) == 6 and all(0 <= v <= 1 for r in at for v in (r.x, r.y))
    assert [r.colour for r in layout.gradient(spark, "#000000", "#ff8000", 3).orderBy("k").collect()] == ["#000000", "#7f4000", "#ff8000"]
    c = layout.bezier(spark.createDataFrame([(0.0, 0.0, 2.0, 0.0)], "x1 double, y1 double, x2 double, y2 double"), 3).first().curve
    assert [(p.x, p.y) for p in c] == [(0, 0), (1, 0.5), (2, 0)]


def test_stream_equals_batch(spark, tmp_path):
    a = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("event_type").alias("layer"))
    a.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    s = streaming.read_activity(spark, str(tmp_path / "in"), "ts timestamp_ntz, layer string", 10)
    streaming.to_table(streaming.windowed_counts(s, "ts", "1 day", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = a.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("start"), "layer").agg(F.count("*").alias("edges"))
    assert got.count() > 50 and got.exceptAll(want.select(*got.columns)).isEmpty()


def test_config():
    assert NetConfig().coupling_weight == 1.0 and not NetConfig().directed


def test_directed_networks_stay_directed(spark, tmp_path):
    net = text.edge_tuples(spark, [("a", "b", "x", "x", 1.0)], NetConfig(directed=True))
    names = spark.createDataFrame([("a",), ("b",)], "node string")
    pairs = spark.createDataFrame([("a", "x"), ("b", "x")], "node string, layer string")
    sinks.save_native(net, str(tmp_path))
    loaded = text.native(spark, str(tmp_path))
    assert loaded.config == net.config and loaded.edges.columns == net.edges.columns
    for kept in (network.subnetwork_layers(net, ["x"]), network.subnetwork_names(net, names), network.subnetwork_pairs(net, pairs), loaded):
        assert kept.get_neighbors("b", "x").count() == 0 and kept.get_neighbors("a", "x").count() == 1


def test_edgelist_merges_turned_lines_unless_directed(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a b 3\nb a 2\na c 1\n")
    path = str(tmp_path / "e.txt")
    rows = lambda net: sorted((r.src, r.dst, r.weight) for r in net.edges.collect())
    assert rows(text.edgelist(spark, path)) == [("a", "c", 1.0), ("b", "a", 2.0)]
    assert rows(text.edgelist(spark, path, NetConfig(directed=True))) == [("a", "b", 3.0), ("a", "c", 1.0), ("b", "a", 2.0)]


def test_nothing_stops_in_silence(spark, tmp_path):
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(70)], "child string, parent string")
    assert rules.closure(chain).where("child = '000'").count() == 71
    assert rules.levels(chain).agg(F.max("level")).first()[0] == 70
    with pytest.raises(ValueError):
        sinks.latex(spark.range(3), most=2)
    with pytest.raises(ValueError):
        iterate.diameter(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), most_nodes=2)
