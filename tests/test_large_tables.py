"""What only shows on tables of many partitions: several ranges, more rows than a sample, midpoints of many points."""

import math
import random
from collections import defaultdict

import pytest
from laminet import session
from laminet.functions import special
from laminet.model import MultilayerNetwork
from laminet.operators import community, hin, iterate, network, stats, temporal
from laminet.plans import queries
from pyspark.sql import functions as F


@pytest.fixture
def many(spark):
    """Shuffles of 16 partitions that stay 16."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_are_numbered_once_each_over_several_ranges(many):
    rows = many.range(0, 100_000, 1, 8).select(F.col("id").alias("event_id"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("ts"), (F.col("id") % 3).cast("string").alias("layer"))
    got = temporal.numbered(rows, ["ts", "event_id"]).select("_n", "ts", "event_id").orderBy("ts", "event_id").toPandas()
    assert got["_n"].tolist() == list(range(100_000))
    sizes = temporal.chunks(rows, 1000, ["ts", "event_id"]).groupBy("chunk").count().collect()
    assert sorted(r.chunk for r in sizes) == list(range(100)) and {r["count"] for r in sizes} == {1000}
    sizes = temporal.layer_counts(temporal.slices(rows, 7, ["ts", "event_id"]), "slice").groupBy("slice").agg(F.sum("edges").alias("n")).orderBy("slice").collect()
    assert [r.n for r in sizes] == [14286] * 5 + [14285] * 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layers_do_not_gather_in_a_join(spark):
    e = spark.createDataFrame([("a", "x", "b", "x"), ("a", "x", "c", "x"), ("b", "y", "a", "y")], "src string, src_layer string, dst string, dst_layer string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = network.aggregate_edges(MultilayerNetwork.from_edges(e))
        assert "BroadcastHashJoin [layer" in plan_of(out) and "SortMergeJoin [src_layer" not in plan_of(out)
        # x: 3 nodes, 2 edges; y: 2 nodes, 1 edge.
        assert {(r.src, r.dst): r.weight for r in out.collect()} == {("a", "b"): 0.75 + 1.0, ("a", "c"): 0.75}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_wide_follows_the_files(spark, tmp_path, monkeypatch):
    spark.range(100_000).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert session.wide(t, "id") is t
    monkeypatch.setattr(session, "TASK_BYTES", 20_000)
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert session.wide(t, "id").rdd.getNumPartitions() == -(-size // 20_000) > 4
    small = spark.createDataFrame([(1,)], "id long")
    assert session.wide(small, "id") is small


#: Points of each midpoint: one of many points, twins (p4 to p9 have the same midpoints), one of a single point, and random ones.
POINTS = {"big": range(40), "twins": range(4, 10), "single": [3]} | {f"m{i}": random.Random(i).sample(range(40, 300), 2 + i % 5) for i in range(60)}
POINTS["few"] = [39, 41]


def network_of(spark):
    rows = [(f"p{p}", m) for m, ps in POINTS.items() for p in ps]
    e = spark.createDataFrame(rows, "c string, m string")
    edges = e.select(F.col("c").alias("src"), F.col("m").alias("dst"), F.lit("purchased").alias("etype")).union(e.select("m", "c", F.lit("purchased_by")))
    labels = [(f"p{p}", "abc"[p % 3]) for p in range(300) if p % 11] + [("p4", "c"), ("p4", "c")]  # p4 has two labels, one of them twice; some have none
    nodes = spark.createDataFrame([(f"p{p}", "customer") for p in range(300)] + [(m, "brand") for m in POINTS], "node string, ntype string")
    return nodes, edges, spark.createDataFrame(labels, "node string, label string"), labels


def test_midpoints_do_not_gather_in_a_join(spark):
    nodes, edges, labels, rows = network_of(spark)
    points = hin.midpoints(nodes, edges, queries.CYCLE)
    assert "SortMergeJoin [mid" not in plan_of(points)
    want = {(m, f"p{p}") for m, ps in POINTS.items() for p in ps if len(ps) > 1}
    assert {(r.mid, r.point) for r in points.collect()} == want
    own = defaultdict(list)
    for n, x in rows:
        own[n].append(x)
    n, kinds = len(own), {x: len({a for a, b in rows if b == x}) for x in "abc"}
    for m, w in hin.midpoint_weights(points, labels, "delta").collect():
        pp = sum(f"p{p}" in own for p in POINTS[m])
        assert w == pytest.approx(sum(abs(ap / (pp + 1) - (n - ap) / (n - pp + 1)) for ap in kinds.values()))
    for m, w in hin.midpoint_weights(points, labels, "rf").collect():
        pp = sum(f"p{p}" in own for p in POINTS[m])
        tp = {x: sum(own.get(f"p{p}", []).count(x) for p in POINTS[m]) for x in "abc"}
        assert w == pytest.approx(sum(math.log2(2 + t / max(1, pp - t)) for t in tp.values()))


@pytest.mark.parametrize("block", [1 << 23, 60])
@pytest.mark.parametrize("heuristic,most", [("okapi", None), ("idf", 7)])
def test_sums_of_the_projection_are_those_of_its_pairs(spark, monkeypatch, block, heuristic, most):
    monkeypatch.setattr(hin, "BLOCK", block)
    nodes, edges, labels, _ = network_of(spark)
    points = hin.midpoints(nodes, edges, queries.CYCLE)
    pairs = hin.decompose(points, labels, heuristic, most=most).groupBy("u").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    want = {r.u: (r.n, pytest.approx(r.w)) for r in pairs.collect()}
    assert {r.u: (r.partners, r.weight) for r in hin.decomposed(points, labels, heuristic, most=most).collect()} == want


def test_a_midpoint_of_many_points_makes_no_pairs(spark, tmp_path):
    """50,000 customers of one brand and size: 2.5 thousand million pairs, which would not end."""
    n = spark.range(50_000)
    n.select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    n.select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    n.select(F.col("id").alias("c_custkey"), F.lit("A").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "b", 2)], "p_partkey int, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = queries._decomposed("tf")(spark, str(tmp_path)).groupBy("partners", "weight").count().collect()
    assert [tuple(r) for r in got] == [(50_000, 50_000.0, 50_000)]


def test_the_schema_is_worked_out_once_for_all_cycles(spark, tmp_path):
    meta = spark.createDataFrame([("a", "e", "b"), ("b", "f", "c"), ("c", "g", "a")], "from_type string, etype string, to_type string").coalesce(1)
    seen = str(tmp_path / "seen")

    def look(batches):
        with open(seen, "a") as f:
            f.write("x")
        yield from batches

    assert [r.length for r in hin.cycles(meta.mapInPandas(look, meta.schema), "a").collect()] == [3]
    with open(seen) as f:
        assert f.read() == "x"


def test_the_exact_test_takes_as_long_as_its_tails():
    """A table of a thousand million, in which there is no going through all others of its margins."""
    assert special.fisher_exact(1, 499_999_999, 0, 500_000_000) == 1.0
    assert special.fisher_exact(20, 499_999_980, 0, 500_000_000) == pytest.approx(2 * 0.5**20, rel=1e-5)
    plain = lambda a, b, c, d: [math.comb(a + c, x) * math.comb(b + d, a + b - x) / math.comb(a + b + c + d, a + b) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
    for t in ((3, 1, 1, 3), (0, 7, 9, 2), (40, 60, 80, 20), (5, 0, 0, 5), (0, 0, 3, 4), (12, 30, 7, 90)):
        p, at = plain(*t), t[0] - max(0, t[0] - t[3])
        assert special.fisher_exact(*t) == pytest.approx(min(1, sum(x for x in p if x <= p[at] * (1 + 1e-7))), rel=1e-9)
        assert special.fisher_exact(*t, "greater") == pytest.approx(min(1, sum(p[at:])), rel=1e-9) and special.fisher_exact(*t, "less") == pytest.approx(min(1, sum(p[: at + 1])), rel=1e-9)


def test_terms_go_to_their_members_whole(spark):
    members = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, None)], "entity long, partition string")
    whole = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "x"]), (2, ["x", "z"]), (3, None), (4, ["x"])], "entity long, terms array<string>")
    want = {("a", "x", 2, 2, 2, 5), ("a", "y", 1, 0, 2, 5), ("a", "z", 1, 1, 2, 5), ("b", "x", 1, 3, 2, 5), ("b", "z", 1, 1, 2, 5)}
    each = whole.select("entity", F.explode("terms").alias("term"))
    for annotations in (whole, each):
        assert {tuple(r) for r in stats.enrichment_counts(members, annotations).collect()} == want


def test_components_go_on_with_fewer_edges(spark, monkeypatch):
    made = []
    monkeypatch.setattr(iterate, "cut", lambda df, name="step": made.append((name, df.count())) or session.cut(df, name))
    names = [f"n{i:03}" for i in range(200)]
    random.Random(5).shuffle(names)  # least neighbours lie anywhere on the path
    ends = list(zip(names, names[1:])) + [("a", f"z{i}") for i in range(50)] + [("b", "b"), ("z1", "z2")]
    e = spark.createDataFrame(ends, "src string, dst string")
    got = {r.node: r.component for r in iterate.connected_components(e, spark.createDataFrame([("alone",)], "node string")).collect()}
    assert got == {n: "n000" for n in names} | {f"z{i}": "a" for i in range(50)} | {"a": "a", "b": "b", "alone": "alone"}
    edges = [n for name, n in made if name == "edges"]
    assert edges[0] == 250 and edges[-1] == 0 and all(y <= x / 2 for x, y in zip(edges, edges[1:]))


def test_links_in_one_layer_are_not_paired(spark):
    rows = [("a", "x", "p", 1.0), ("a", "x", "q", 3.0), ("a", "y", "q", 1.0), ("a", "y", "r", 1.0), ("a", "y", "r", 2.0), ("a", "z", "s", 5.0), ("b", "x", "p", 2.0)]
    e = spark.createDataFrame([(s, k, d, k, w) for s, k, d, w in rows], "src string, src_layer string, dst string, dst_layer string, weight double")
    out = community.jensen_shannon(e)
    assert "Union" not in plan_of(out)
    x, y = {"p": 0.25, "q": 0.75}, {"q": 0.25, "r": 0.75}
    want = sum(0.5 * w * math.log2(w / ((x.get(k, 0) + y.get(k, 0)) / 2)) for p in (x, y) for k, w in p.items())
    assert {(r.node, r.layer_a, r.layer_b): r.divergence for r in out.collect()} == {("a", "x", "y"): pytest.approx(want), ("a", "x", "z"): 1.0, ("a", "y", "z"): 1.0}


def test_edges_are_merged_before_they_are_turned(spark):
    rows = [("1", "x", "2", "x", 2.0), ("2", "x", "1", "x", 5.0), ("2", "x", "2", "x", 1.0), ("1", "y", "2", "x", 3.0)]
    net = MultilayerNetwork.from_edges(spark.createDataFrame(rows, "src string, src_layer string, dst string, dst_layer string, weight double"))
    assert "Union" not in plan_of(network.supra_adjacency(net))
    plain = {(0, 2): 5.0, (2, 0): 5.0, (2, 2): 1.0, (1, 2): 3.0, (2, 1): 3.0}  # 1 in x, 1 in y, 2 in x
    assert {(r.i, r.j): r.v for r in network.supra_adjacency(net).collect()} == plain
    coupled = plain | {(0, 1): 1.0, (1, 0): 1.0}
    assert {(r.i, r.j): r.v for r in network.supra_adjacency(net, coupling=True).collect()} == coupled
    wider = network.node_index(net).union(spark.createDataFrame([("2", "y", 3)], "node string, layer string, i long"))
    assert {(r.i, r.j): r.v for r in network.supra_adjacency(net, coupling=True, index=wider).collect()} == coupled
