"""Iterative graph algebra on edge tables (src, dst, weight): each step is a join and an aggregation, and lineage is cut."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.model import symmetrize
from laminet.session import cut, discard

PAIR = ["src", "dst"]


def summed(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*PAIR).agg(F.sum("weight").alias("weight"))


def names_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


# Normalisation


def stochastic(edges: DataFrame) -> DataFrame:
    """No self loops; weights over the sum of their source's: (src, dst, p)."""
    e = summed(edges.where("src <> dst"))
    total = e.groupBy("src").agg(F.sum("weight").alias("_t"))
    return e.join(total, "src").where("_t > 0").select("src", "dst", (F.col("weight") / F.col("_t")).alias("p"))


def symmetric(edges: DataFrame) -> DataFrame:
    """No self loops; weights over the square root of both ends' row sums: (src, dst, s)."""
    e = summed(edges.where("src <> dst"))
    total = e.groupBy("src").agg(F.sum("weight").alias("_t"))
    e = e.join(total.withColumnRenamed("_t", "_a"), "src").join(total.toDF("dst", "_b"), "dst")
    return e.where("_a > 0 and _b > 0").select("src", "dst", (F.col("weight") / F.sqrt(F.col("_a") * F.col("_b"))).alias("s"))


# Ranking


def personalized_pagerank(p: DataFrame, seeds: DataFrame, damping: float = 0.85, steps: int | None = None, epsilon: float = 1e-6, most: int = 100_000, zero_seeds: bool = True, unit: bool = True, threshold: float = 0.0) -> DataFrame:
    """p: stochastic edges (src, dst, p). seeds: (seed, node) start sets, spread evenly. Returns (seed, node, rank).

    r becomes damping * (P'r + start * missing mass) + (1 - damping) * start, the missing mass being counted where more
    than 1e-9 is missing, for a number of steps or until no seed's vector moves by more than epsilon (sum of absolute
    differences). Seeds' own entries are left out then and vectors scaled to length 1, unless told otherwise. threshold
    drops smaller entries at each step. Not having converged after `most` steps gives a warning.
    """
    start = seeds.select("seed", "node").distinct()
    start = cut(start.withColumn("start", 1.0 / F.count("*").over(Window.partitionBy("seed"))), "start")
    rank = start.select("seed", "node", F.col("start").alias("rank"))
    p = cut(p.select("src", "dst", "p"), "transitions")
    for _ in range(steps if steps is not None else most):
        moved = rank.join(p, rank["node"] == p["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("m"))
        mass = moved.groupBy("seed").agg(F.sum("m").alias("_mass"))
        lost = start.join(mass, "seed", "left").select("seed", "node", (F.col("start") * F.when(1 - F.coalesce("_mass", F.lit(0.0)) > 1e-9, 1 - F.coalesce("_mass", F.lit(0.0))).otherwise(0.0)).alias("m"))
        back = start.select("seed", "node", (F.col("start") * (1 - damping) / damping).alias("m"))
        new = moved.unionByName(lost).unionByName(back).groupBy("seed", "node").agg((damping * F.sum("m")).alias("rank"))
        new = cut(new.where(F.col("rank") > threshold), "rank")
        if steps is None:
            a, b = new.withColumnRenamed("rank", "_a"), rank.withColumnRenamed("rank", "_b")
            far = a.join(b, ["seed", "node"], "full").groupBy("seed").agg(F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))).alias("d")).agg(F.max("d")).first()[0]
            rank = new
            if (far or 0.0) <= epsilon:
                break
        rank = new
    else:
        if steps is None:
            warnings.warn(f"not converged after {most} steps", stacklevel=2)
    if zero_seeds:
        rank = rank.join(start.select("seed", "node"), ["seed", "node"], "left_anti")
    if unit:
        rank = rank.withColumn("rank", F.col("rank") / F.sqrt(F.sum(F.col("rank") * F.col("rank")).over(Window.partitionBy("seed"))))
    return rank


def all_ppr(edges: DataFrame, targets: DataFrame | None = None, **options) -> DataFrame:
    """A vector for each node (or each of targets: node): (seed, node, rank)."""
    at = names_of(edges) if targets is None else targets.select("node").distinct()
    return personalized_pagerank(stochastic(edges), at.select(F.col("node").alias("seed"), "node"), **options)


def pagerank(edges: DataFrame, damping: float = 0.85, steps: int = 20) -> DataFrame:
    """(node, rank); dangling mass goes to all nodes evenly."""
    nodes = cut(names_of(edges), "nodes")
    n = nodes.count()
    p = cut(stochastic(edges), "transitions")
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for _ in range(steps):
        moved = rank.join(p, rank["node"] == p["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("m"))
        kept = moved.agg(F.coalesce(F.sum("m"), F.lit(0.0))).first()[0]
        rank = cut(nodes.join(moved, "node", "left").select("node", ((1 - damping) / n + damping * (F.coalesce("m", F.lit(0.0)) + (1 - kept) / n)).alias("rank")), "rank")
    return rank


def hits(edges: DataFrame, steps: int = 50) -> DataFrame:
    """(node, hub, authority), each scaled to a sum of 1."""
    nodes = cut(names_of(edges), "nodes")
    e = cut(summed(edges), "edges")
    hub = nodes.withColumn("v", F.lit(1.0))
    authority = hub

    def move(x: DataFrame, a: str, b: str) -> DataFrame:
        y = x.join(e, x["node"] == e[a]).groupBy(F.col(b).alias("node")).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
        total = y.agg(F.sum("v")).first()[0] or 1.0
        return cut(nodes.join(y, "node", "left").select("node", (F.coalesce("v", F.lit(0.0)) / total).alias("v")), "hits")

    for _ in range(steps):
        authority = move(hub, "src", "dst")
        hub = move(authority, "dst", "src")
    return hub.withColumnRenamed("v", "hub").join(authority.withColumnRenamed("v", "authority"), "node")


def hub_matrix(edges: DataFrame) -> DataFrame:
    """A A': (i, j, v)."""
    e = summed(edges)
    return e.toDF("i", "k", "a").join(e.toDF("j", "k", "b"), "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def authority_matrix(edges: DataFrame) -> DataFrame:
    """A' A: (i, j, v)."""
    return hub_matrix(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


# Label propagation

PRENORMALISERS = {
    "basic": lambda v, total: v,
    "freq": lambda v, total: v / total,
    "freq_amplify": lambda v, total: v * total,
    "exp": lambda v, total: F.exp(v),
}


def label_propagation(edges: DataFrame, labels: DataFrame, alpha: float = 0.001, steps: int = 20, epsilon: float | None = None, scheme: str = "basic") -> DataFrame:
    """labels: (node, label, v). F becomes alpha * S F + (1 - alpha) * Y over symmetrically normalised edges, for a number of
    steps or until the relative change is at most epsilon. Returns (node, label, v)."""
    if scheme not in PRENORMALISERS:
        raise ValueError(f"no scheme {scheme!r}")
    total = F.sum("v").over(Window.partitionBy("label"))
    y = cut(labels.select("node", "label", PRENORMALISERS[scheme](F.col("v").cast("double"), total).alias("v")), "labels")
    s, now = cut(symmetric(edges), "similar"), y
    for _ in range(steps):
        moved = now.join(s, now["node"] == s["dst"]).select(F.col("src").alias("node"), "label", (alpha * F.col("v") * F.col("s")).alias("v"))
        new = cut(moved.unionByName(y.select("node", "label", ((1 - alpha) * F.col("v")).alias("v"))).groupBy("node", "label").agg(F.sum("v").alias("v")), "propagated")
        if epsilon is not None:
            d = new.withColumnRenamed("v", "a").join(now.withColumnRenamed("v", "b"), ["node", "label"], "full").fillna(0.0, ["a", "b"])
            far, size = d.agg(F.sum((F.col("a") - F.col("b")) ** 2), F.sum(F.col("a") ** 2)).first()
            now = new
            if not size or (far / size) ** 0.5 <= epsilon:
                break
        now = new
    return now


# Traversal


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component), the component being its least name. Each node goes to its least neighbour if that is less than itself, and on to
    where that leads; then edges run between where their ends went, and far fewer are left, until none is."""
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    e = cut(edges.where("src <> dst").select(*pair).distinct(), "edges")
    every = names_of(edges) if nodes is None else nodes.select("node").union(names_of(edges)).distinct()
    label = cut(every.select("node", F.col("node").alias("component")), "labels")
    while not e.isEmpty():
        # The least name of a component never moves, so that it is what all of them come to.
        to = cut(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "spread")
        while True:
            on = to.join(to.toDF("_n", "_on"), F.col("to") == F.col("_n"), "left")
            new = cut(on.select("node", F.coalesce("_on", "to").alias("to"), F.col("_on").isNotNull().alias("_moved")), "jump")
            discard(to)
            to = new.select("node", "to")
            to.cut_path = new.cut_path
            if new.where("_moved").isEmpty():
                break
        went = label.join(to, label["component"] == to["node"], "left").select(label["node"], F.coalesce("to", "component").alias("component"))
        x = e.join(to.toDF("b", "src"), "b").join(to.toDF("a", "_a"), "a", "left").select("src", F.coalesce("_a", "a").alias("dst"))
        went, x = cut(went, "labels"), cut(x.where("src <> dst").select(*pair).distinct(), "edges")
        discard(label, e, to)
        label, e = went, x
    return label


def bfs(edges: DataFrame, start: DataFrame, directed: bool = False, most: int | None = None) -> DataFrame:
    """(node, level): steps from the start nodes (node) to all that they reach, or those within most steps."""
    e = cut((edges if directed else symmetrize(edges.select("src", "dst"))).select("src", "dst").distinct(), "edges")
    seen = cut(start.select("node").distinct().withColumn("level", F.lit(0)), "level")
    front = seen
    for level in count(1) if most is None else range(1, most + 1):
        front = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(level))
        front = cut(front, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def diameter(edges: DataFrame, most_nodes: int = 2000) -> int | None:
    """Longest shortest path of a connected undirected graph by search from every node; None if it isn't connected. More than most_nodes raise."""
    nodes = names_of(edges)
    n = nodes.count()
    if n == 0:
        return None
    if n > most_nodes:
        raise ValueError(f"{n} nodes are more than {most_nodes}: a search from every node needs a row for each pair")
    e = cut(symmetrize(edges.select("src", "dst")).distinct(), "edges")
    seen = cut(nodes.select(F.col("node").alias("s"), "node"), "seen")
    front, level = seen, 0
    while True:
        front = cut(front.join(e, front["node"] == e["src"]).select("s", F.col("dst").alias("node")).distinct().join(seen, ["s", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        level += 1
        seen = seen.unionByName(front)
    return level if seen.count() == n * n else None


def hops(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """Nodes within k steps of the start nodes, these left out."""
    return bfs(edges, start, most=k).where("level > 0").select("node")


def _draw(walker: Column, step: int, n: Column, seed: int) -> Column:
    """An even choice from 0 to n - 1 by integer arithmetic that SQL engines share."""
    mixed = (walker * F.lit(2654435761) + F.lit(step * 40503 + seed * 7919)) % F.lit(2**32)
    return (mixed * F.lit(48271) % F.lit(2147483647)) % n


def random_walks(edges: DataFrame, walkers: DataFrame, steps: int, teleport: float = 0.0, seed: int = 1, directed: bool = False) -> DataFrame:
    """walkers: (walker long, node). Returns (walker, step, node) with step 0. Each step goes to an even choice of the node's
    neighbours in order of name; walkers at a dead end stay. With probability teleport a walker first goes back to an
    earlier node of its walk."""
    e = (edges if directed else symmetrize(edges.select("src", "dst"))).select("src", "dst").distinct()
    e = e.withColumns({"k": F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1, "n": F.count("*").over(Window.partitionBy("src"))})
    e = cut(e, "numbered")
    counts = e.where("k = 0").select(F.col("src").alias("node"), "n")
    now = cut(walkers.select(F.col("walker").cast("long"), "node").withColumn("step", F.lit(0)), "walk")
    path = now
    for step in range(1, steps + 1):
        at = now
        if teleport > 0:
            back = path.select(F.col("walker").alias("_w"), F.col("step").alias("_s"), F.col("node").alias("_back"))
            jump = (F.abs(F.xxhash64("walker", F.lit(seed), F.lit(step))) % 1000000) < int(teleport * 1e6)
            at = now.withColumns({"_j": jump, "_t": (F.abs(F.xxhash64("walker", F.lit(seed + 1), F.lit(step))) % step).cast("int")})
            at = at.join(back, (F.col("walker") == F.col("_w")) & (F.col("_t") == F.col("_s"))).withColumn("node", F.when(F.col("_j"), F.col("_back")).otherwise(F.col("node")))
        at = at.select("walker", "node").join(counts, "node", "left")
        at = at.withColumn("k", _draw(F.col("walker"), step, F.coalesce("n", F.lit(1)), seed).cast("int"))
        went = at.join(e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("k").alias("_k")), (F.col("node") == F.col("_s")) & (F.col("k") == F.col("_k")), "left")
        now = cut(went.select("walker", F.coalesce("_d", "node").alias("node"), F.lit(step).alias("step")), "walk")
        path = path.unionByName(now)
    return path.select("walker", "step", "node")


def biased_walks(edges: DataFrame, walkers: DataFrame, steps: int, p: float = 1.0, q: float = 1.0, seed: int = 1) -> DataFrame:
    """Second-order walks: going back weighs 1/p, going to a neighbour of the last node 1, farther 1/q; the choice is the
    least of exponential draws by these weights. Returns (walker, step, node)."""
    e = cut(symmetrize(summed(edges)).groupBy(*PAIR).agg(F.max("weight").alias("weight")), "edges")
    near = e.select(F.col("src").alias("_p"), F.col("dst").alias("_n"), F.lit(True).alias("_near"))
    now = cut(walkers.select("walker", "node", F.lit(None).cast("string").alias("last")).withColumn("step", F.lit(0)), "walk")
    path = now.select("walker", "step", "node")
    for step in range(1, steps + 1):
        to = now.join(e, now["node"] == e["src"]).join(near, (F.col("last") == F.col("_p")) & (F.col("dst") == F.col("_n")), "left")
        w = F.col("weight") * F.when(F.col("last").isNull(), 1.0).when(F.col("dst") == F.col("last"), 1 / p).when(F.col("_near"), 1.0).otherwise(1 / q)
        u = (F.xxhash64("walker", "dst", F.lit(seed), F.lit(step)) / F.lit(2.0**64)) + 0.5
        best = to.groupBy("walker").agg(F.min_by(F.struct(F.col("dst").alias("node"), F.col("node").alias("last")), -F.ln(F.greatest(u, F.lit(1e-18))) / w).alias("b"))
        now = cut(best.select("walker", "b.node", "b.last", F.lit(step).alias("step")), "walk")
        path = path.unionByName(now.select("walker", "step", "node"))
    return path


# Centrality


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs without loops: (src, dst), src < dst."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def degree_centrality(edges: DataFrame, side: str = "both") -> DataFrame:
    """(node, value): degree in the simple graph over n - 1; side in or out counts directed edges."""
    e = undirected(edges) if side == "both" else edges.select("src", "dst").distinct()
    ends = {"both": F.array("src", "dst"), "out": F.array("src"), "in": F.array("dst")}[side]
    d = e.select(F.explode(ends).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    nodes = names_of(edges)
    n = nodes.agg(F.count("*").alias("_n")).withColumn("_k", F.lit(0))
    return nodes.join(d, "node", "left").withColumn("_k", F.lit(0)).join(F.broadcast(n), "_k").select("node", (F.coalesce("d", F.lit(0)) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("value"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of each triangle once. Edges point from the lower to the higher (degree, name), which bounds what a hub sends."""
    e = undirected(edges)
    d = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    e = e.join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedge = e.toDF("u", "v").join(e.toDF("u", "w"), "u").where("v < w")
    closing = e.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("w"))
    t = wedge.join(closing, ["v", "w"])
    return t.select(F.sort_array(F.array("u", "v", "w")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, value) of the simple graph."""
    e = undirected(edges)
    d = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = names_of(edges).join(d, "node", "left").join(t, "node", "left").fillna(0, ["degree", "triangles"])
    k = F.col("degree")
    return d.withColumn("value", F.when(k > 1, 2 * F.col("triangles") / (k * (k - 1))).otherwise(0.0))


def betweenness(edges: DataFrame, kind: str = "betweenness", most_edges: int = 2_000_000) -> DataFrame:
    """(node, value), normalised, of the simple undirected graph: betweenness, or closeness. Sources are dealt to tasks, each of
    which holds the graph, so it is refused beyond most_edges."""
    pairs = undirected(edges)
    if pairs.count() > most_edges:
        raise ValueError("the graph is too large to be held by each task")
    near: dict[str, list[str]] = {}
    for a, b in pairs.toLocalIterator():
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    shared = edges.sparkSession.sparkContext.broadcast(near)
    n = len(near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = shared.value
        for g in batches:
            rows: list[tuple[str, float]] = []
            for s in g["node"]:
                level, paths, before, order = {s: 0}, {s: 1.0}, {s: []}, [s]
                for v in order:
                    for w in graph.get(v, ()):
                        if w not in level:
                            level[w], paths[w], before[w] = level[v] + 1, 0.0, []
                            order.append(w)
                        if level[w] == level[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                if kind == "closeness":
                    total = sum(level.values())
                    rows.append((s, (len(level) - 1) / total * (len(level) - 1) / (n - 1) if total else 0.0))
                    continue
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        rows.append((w, share[w]))
            yield pd.DataFrame(rows, columns=["node", "value"])

    nodes = names_of(edges)
    got = nodes.repartition(edges.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "node string, value double")
    scale = 1.0 if kind == "closeness" else 1.0 / max(1, (n - 1) * (n - 2))
    got = got.groupBy("node").agg((F.sum("value") * scale).alias("value"))
    return nodes.join(got, "node", "left").fillna(0.0, ["value"])


#: Measures of a single layer by name. Unknown names raise; nothing is ever evaluated from a string.
REGISTRY = {
    "degree_centrality": degree_centrality,
    "in_degree_centrality": lambda e: degree_centrality(e, "in"),
    "out_degree_centrality": lambda e: degree_centrality(e, "out"),
    "pagerank": lambda e: pagerank(e).withColumnRenamed("rank", "value"),
    "hubs": lambda e: hits(e).select("node", F.col("hub").alias("value")),
    "authorities": lambda e: hits(e).select("node", F.col("authority").alias("value")),
    "clustering": lambda e: clustering(e).select("node", "value"),
    "triangles": lambda e: clustering(e).select("node", F.col("triangles").cast("double").alias("value")),
    "betweenness_centrality": betweenness,
    "closeness_centrality": lambda e: betweenness(e, "closeness"),
    "connected_components": connected_components,
}


def measure(name: str, edges: DataFrame) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"no measure {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](edges)


def network_statistics(edges: DataFrame, name: str = "network", classes: int = 0, directed: bool = False, most_nodes: int = 2000) -> dict:
    """One row of figures: nodes, edges, components, clustering, density, diameter, mean degree, flow hierarchy."""
    nodes = names_of(edges).count()
    m = edges.count()
    out = {"name": name, "classes": classes, "nodes": nodes, "edges": m, "mean_degree": 2 * m / nodes if nodes else 0.0}
    out["components"] = connected_components(edges).select("component").distinct().count()
    out["clustering"] = clustering(edges).agg(F.avg("value")).first()[0]
    out["density"] = (1 if directed else 2) * m / (nodes * (nodes - 1)) if nodes > 1 else 0.0
    out["diameter"] = diameter(edges, most_nodes) if nodes <= most_nodes else "not searched"
    out["flow_hierarchy"] = flow_hierarchy(edges) if directed else None
    return out


def flow_hierarchy(edges: DataFrame) -> float:
    """Share of edges on no cycle. Nodes that lack a way in or out are peeled off, then an edge is on a cycle if its source
    can be reached from its target."""
    m = edges.count()
    core = cut(edges.select("src", "dst").distinct(), "core")
    while True:
        n = core.count()
        new = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        core = cut(new, "core")
        if core.count() == n:
            break
    reach = core
    while True:
        n = reach.count()
        wider = reach.toDF("src", "m").join(reach.toDF("m", "dst"), "m").select("src", "dst")
        reach = cut(reach.union(wider).distinct(), "reach")
        if reach.count() == n:
            break
    cyclic = edges.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").count()
    return 1 - cyclic / m if m else 0.0


def simrank(edges: DataFrame, c: float = 0.9, steps: int = 5) -> DataFrame:
    """(a, b, s) over pairs with a common neighbour chain; undirected simple graph. For graphs of few nodes."""
    e = undirected(edges)
    e = e.union(e.select("dst", "src"))
    d = e.groupBy("src").agg(F.count("*").alias("d"))
    nodes = names_of(edges)
    s = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("s"))
    for _ in range(steps):
        t = s.join(e.toDF("x", "a"), "a").groupBy("x", "b").agg(F.sum("s").alias("s")).join(e.toDF("y", "b"), "b").groupBy("x", "y").agg(F.sum("s").alias("s"))
        t = t.where("x <> y").join(d.toDF("x", "dx"), "x").join(d.toDF("y", "dy"), "y").select(F.col("x").alias("a"), F.col("y").alias("b"), (c * F.col("s") / (F.col("dx") * F.col("dy"))).alias("s"))
        s = cut(t.unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("s"))), "simrank")
    return s


def correlation_network(data: DataFrame, key: str, variable: str, value: str) -> DataFrame:
    """(a, b, rho): Spearman correlation of all pairs of variables over their common keys (mean ranks for ties)."""
    w = Window.partitionBy(variable).orderBy(value)
    ties = Window.partitionBy(variable, value)
    r = data.withColumn("_r", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2).select(F.col(key).alias("k"), F.col(variable).alias("v"), "_r")
    a, b = r.toDF("k", "a", "ra"), r.toDF("k", "b", "rb")
    return a.join(b, "k").where("a < b").groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho"))


def scale_free_threshold(rho: DataFrame, steps: int = 50, enough: float = 0.8) -> float:
    """The first of evenly spaced thresholds at which log counts against log degrees are linear with |r| over `enough`, else the best."""
    marks = rho.sparkSession.range(steps).select((F.col("id") / (steps - 1)).alias("t"))
    kept = rho.join(F.broadcast(marks), F.abs("rho") >= F.col("t")).select("t", F.explode(F.array("a", "b")).alias("node"))
    hist = kept.groupBy("t", "node").agg(F.count("*").alias("d")).groupBy("t", "d").agg(F.count("*").alias("n"))
    fit = hist.groupBy("t").agg(F.abs(F.corr(F.ln("d"), F.ln("n"))).alias("r"), F.count("*").alias("k")).where("k > 2 and r is not null and not isnan(r)").orderBy("t").collect()
    good = [x["t"] for x in fit if x["r"] > enough]
    return good[0] if good else max(fit, key=lambda x: x["r"])["t"] if fit else 0.0
