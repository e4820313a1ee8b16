"""Communities: modularity, the map equation, greedy optimisers of both, and related operators.

edges: (src, dst, weight), undirected unless said otherwise; partition: (node, community).
"""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.operators.iterate import all_ppr, connected_components, names_of, undirected
from laminet.session import cut


def plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(F.when(p > 0, p))).otherwise(F.lit(0.0))


def with_communities(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges with the communities ca and cb of their ends."""
    p = partition.select("node", "community")
    return edges.join(p.toDF("src", "ca"), "src").join(p.toDF("dst", "cb"), "dst")


def modularity(edges: DataFrame, partition: DataFrame, directed: bool = False) -> DataFrame:
    """One row: the sum over communities of inner weight over the total, less the product of the shares of outgoing and
    incoming weight. Undirected edges count in both directions, self loops twice."""
    e = with_communities(edges, partition)
    w = e.select("ca", "cb", "weight")
    if not directed:
        w = w.union(e.select("cb", "ca", "weight"))
    total = w.agg(F.sum("weight").alias("t")).withColumn("_j", F.lit(0))
    inner = w.groupBy(F.col("ca").alias("c")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("out"))
    coming = w.groupBy(F.col("cb").alias("c")).agg(F.sum("weight").alias("into"))
    per = inner.join(coming, "c", "full").fillna(0.0, ["inside", "out", "into"]).withColumn("_j", F.lit(0)).join(F.broadcast(total), "_j")
    t = F.col("t")
    return per.agg(F.sum(F.col("inside") / t - F.col("out") * F.col("into") / (t * t)).alias("modularity"))


def modularity_louvain(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: the sum of in_c / m - (deg_c / 2m)^2, a self loop counting once in in_c and twice in deg_c."""
    e = with_communities(edges, partition)
    m = e.agg(F.sum("weight").alias("m")).withColumn("_j", F.lit(0))
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("deg"))
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inside"))
    per = ends.join(inside, "c", "left").fillna(0.0, ["inside"]).withColumn("_j", F.lit(0)).join(F.broadcast(m), "_j")
    return per.agg(F.sum(F.col("inside") / F.col("m") - (F.col("deg") / (2 * F.col("m"))) ** 2).alias("modularity"))


def sizes(partition: DataFrame) -> DataFrame:
    return partition.groupBy("community").agg(F.count("*").alias("size"))


def members(partition: DataFrame) -> DataFrame:
    return partition.groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("members"))


def top_communities(partition: DataFrame, n: int) -> DataFrame:
    return sizes(partition).orderBy(F.desc("size"), "community").limit(n)


def induced(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """The graph of communities: (src, dst, weight), src <= dst, loops holding the inner weight."""
    e = with_communities(edges, partition)
    return e.groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum("weight").alias("weight"))


def fill_unmapped(nodes: DataFrame, partition: DataFrame, community=1) -> DataFrame:
    return nodes.select("node").distinct().join(partition, "node", "left").select("node", F.coalesce("community", F.lit(community)).alias("community"))


def renumber(partition: DataFrame) -> DataFrame:
    """Communities numbered from 0 by their least member."""
    low = partition.groupBy("community").agg(F.min("node").alias("low"))
    low = low.withColumn("number", (F.row_number().over(Window.orderBy("low")) - 1).cast("long"))
    return partition.join(low, "community").select("node", F.col("number").alias("community"))


def codelength(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: bits a step of the two-level map equation for undirected flow, and those of one module (one_level)."""
    e = with_communities(edges, partition)
    total = 2 * F.col("m")
    m = e.agg(F.sum("weight").alias("m")).withColumn("_j", F.lit(0))
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("ca").alias("c")), F.struct(F.col("dst").alias("node"), F.col("cb").alias("c")))).alias("x"), "weight").select("x.node", "x.c", "weight")
    flow = ends.groupBy("node", "c").agg(F.sum("weight").alias("f")).withColumn("_j", F.lit(0)).join(F.broadcast(m), "_j").select("node", "c", (F.col("f") / total).alias("f"))
    cutting = e.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("x")).withColumn("_j", F.lit(0)).join(F.broadcast(m), "_j").select("c", (F.col("x") / total).alias("exit"))
    modules = flow.groupBy("c").agg(F.sum("f").alias("f")).join(cutting, "c", "left").fillna(0.0, ["exit"])
    per_node = flow.agg(F.sum(plogp(F.col("f"))).alias("nodes")).withColumn("_j", F.lit(0))
    per_module = modules.agg(F.sum("exit").alias("leave"), F.sum(plogp(F.col("exit"))).alias("exits"), F.sum(plogp(F.col("exit") + F.col("f"))).alias("both")).withColumn("_j", F.lit(0))
    return per_node.join(per_module, "_j").select((plogp(F.col("leave")) - 2 * F.col("exits") - F.col("nodes") + F.col("both")).alias("codelength"), (-F.col("nodes")).alias("one_level"))


# Greedy optimisers of one component, in memory


def _adjacency(rows) -> tuple[dict, dict]:
    near: dict = defaultdict(dict)
    loops: dict = defaultdict(float)
    for a, b, w in rows:
        if a == b:
            loops[a] += w
        else:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    return near, loops


def _contract(near: dict, loops: dict, at: dict) -> tuple[dict, dict]:
    new: dict = defaultdict(dict)
    inner: dict = defaultdict(float)
    for a, ws in near.items():
        ca = at[a]
        for b, w in ws.items():
            cb = at[b]
            if ca == cb:
                inner[ca] += w / 2
            else:
                new[ca][cb] = new[ca].get(cb, 0.0) + w
    for a, w in loops.items():
        inner[at[a]] += w
    return new, inner


def louvain_levels(rows, resolution: float = 1.0, least: float = 1e-7, seed: int | None = None) -> list[dict]:
    """Levels of local moving and contraction: each maps what the level below calls a node to a community."""
    near, loops = _adjacency(rows)
    nodes = sorted(set(near) | set(loops), key=str)
    m = sum(sum(ws.values()) for ws in near.values()) / 2 + sum(loops.values())
    if m <= 0:
        return [{n: n for n in nodes}]
    rng, levels = random.Random(seed), []
    while True:
        deg = {n: sum(near[n].values()) + 2 * loops[n] for n in nodes}
        at, load = {n: n for n in nodes}, dict(deg)
        gained = 0.0
        while True:
            gain, order = 0.0, list(nodes)
            if seed is not None:
                rng.shuffle(order)
            for n in order:
                own = at[n]
                links: dict = defaultdict(float)
                for b, w in near[n].items():
                    links[at[b]] += w
                load[own] -= deg[n]
                stay = links[own] - resolution * load[own] * deg[n] / (2 * m)
                best, most = own, 0.0
                for c, w in links.items():
                    x = w - resolution * load[c] * deg[n] / (2 * m) - stay
                    if x > most + 1e-15:
                        best, most = c, x
                load[best] += deg[n]
                at[n] = best
                gain += most / m
            gained += gain
            if gain < least:
                break
        levels.append(at)
        if gained < least or len(set(at.values())) == len(nodes):
            return levels
        near, loops = _contract(near, loops, at)
        nodes = sorted(set(at.values()), key=str)


def flatten(levels: list[dict], level: int | None = None) -> dict:
    out = dict(levels[0])
    for up in levels[1 : None if level is None else level + 1]:
        out = {n: up.get(c, c) for n, c in out.items()}
    return out


def map_equation_search(rows, trials: int = 1, seed: int = 123, loops_most: int = 10, least: float = 1e-10) -> dict:
    """Two-level partition of least codelength found: modules of moved nodes, contracted and moved again, and then single nodes once more."""
    near0, loops0 = _adjacency(rows)
    every = sorted(set(near0) | set(loops0), key=str)
    total = sum(sum(ws.values()) for ws in near0.values()) + 2 * sum(loops0.values())
    pl = lambda p: p * math.log2(p) if p > 1e-300 else 0.0
    if total <= 0:
        return {n: n for n in every}
    flow0 = {n: (sum(near0[n].values()) + 2 * loops0[n]) / total for n in every}
    node_term = sum(map(pl, flow0.values()))

    def move(near, flow, at, rng):
        """Moves nodes between modules while that shortens the code."""
        out = {n: sum(near[n].values()) / total for n in flow}
        f, x = defaultdict(float), defaultdict(float)
        for n, c in at.items():
            f[c] += flow[n]
        for n, ws in near.items():
            for b, w in ws.items():
                if at[n] != at[b]:
                    x[at[n]] += w / total
        leave = sum(x.values())
        order = list(flow)
        for _ in range(loops_most):
            moved = 0
            rng.shuffle(order)
            for n in order:
                c = at[n]
                links: dict = defaultdict(float)
                for b, w in near[n].items():
                    links[at[b]] += w / total
                best, gain = c, -least
                xc = x[c] - out[n] + 2 * links[c]
                for d, w in sorted(links.items(), key=lambda kv: str(kv[0])):
                    if d == c:
                        continue
                    xd = x[d] + out[n] - 2 * w
                    new_leave = leave - x[c] - x[d] + xc + xd
                    delta = pl(new_leave) - pl(leave) - 2 * (pl(xc) + pl(xd) - pl(x[c]) - pl(x[d])) + pl(xc + f[c] - flow[n]) + pl(xd + f[d] + flow[n]) - pl(x[c] + f[c]) - pl(x[d] + f[d])
                    if delta < gain:
                        best, gain, found = d, delta, (xd, new_leave)
                if best != c:
                    x[c], f[c] = xc, f[c] - flow[n]
                    x[best], leave = found
                    f[best] += flow[n]
                    at[n] = best
                    moved += 1
            if not moved:
                break
        return at

    def length(at):
        f, x = defaultdict(float), defaultdict(float)
        for n, c in at.items():
            f[c] += flow0[n]
            for b, w in near0[n].items():
                if at[b] != c:
                    x[c] += w / total
        return pl(sum(x.values())) - 2 * sum(map(pl, x.values())) - node_term + sum(pl(x[c] + f[c]) for c in f)

    best, shortest = dict.fromkeys(every, 0), -node_term
    for trial in range(trials):
        rng = random.Random(seed + trial)
        at = {n: i for i, n in enumerate(every)}
        while True:
            before = length(at)
            at = move(near0, flow0, at, rng)
            near, _ = _contract(near0, loops0, at)
            flow: dict = defaultdict(float)
            for n, c in at.items():
                flow[c] += flow0[n]
            up = move(defaultdict(dict, near), flow, {c: c for c in flow}, rng)
            at = {n: up[c] for n, c in at.items()}
            if length(at) > before - least:
                break
        if (now := length(at)) < shortest - least:
            best, shortest = at, now
    return best


def _per_component(edges: DataFrame, solve, nodes: DataFrame | None = None) -> DataFrame:
    """Runs solve (rows to {node: community}) on each connected component in a task of its own; communities are named by their least node.
    A component is held in memory: for larger ones there is label_moving()."""
    part = connected_components(edges, nodes)
    e = edges.join(part.toDF("src", "component"), "src").select("component", "src", "dst", "weight")

    def run(g):
        at = solve(list(g[["src", "dst", "weight"]].itertuples(index=False, name=None)))
        low: dict = {}
        for n, c in at.items():
            low[c] = min(low.get(c, n), n)
        return pd.DataFrame([(n, low[c]) for n, c in at.items()], columns=["node", "community"])

    got = e.groupBy("component").applyInPandas(run, "node string, community string")
    return part.select("node").join(got, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


def louvain(edges: DataFrame, resolution: float = 1.0, weighted: bool = False, seed: int | None = None) -> DataFrame:
    """(node, community) of greedy modularity; the graph is flattened to a simple, unweighted one unless weighted. The null model of a
    component leaves the others out, so its resolution is scaled by its share of all edges."""
    e = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight")) if weighted else undirected(edges).withColumn("weight", F.lit(1.0))
    total = e.agg(F.sum("weight")).first()[0] or 1.0

    def solve(rows):
        own = sum(w for *_, w in rows)
        return flatten(louvain_levels(rows, resolution * own / total, seed=seed))

    return _per_component(e, solve, names_of(edges).select("node"))


def dendrogram(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(level, child, parent) of a connected graph's Louvain levels."""
    rows = [tuple(r) for r in undirected(edges).withColumn("weight", F.lit(1.0)).toLocalIterator()]
    out = [(i, str(a), str(b)) for i, level in enumerate(louvain_levels(rows, resolution)) for a, b in level.items()]
    return edges.sparkSession.createDataFrame(out, "level int, child string, parent string")


def partition_at_level(levels: DataFrame, level: int) -> DataFrame:
    """(node, community) by chained joins over a dendrogram (level, child, parent)."""
    out = levels.where("level = 0").select(F.col("child").alias("node"), F.col("parent").alias("community"))
    for k in range(1, level + 1):
        up = levels.where(F.col("level") == k).select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
        out = out.join(up, out["community"] == up["_c"], "left").select("node", F.coalesce("_p", "community").alias("community"))
    return out


def infomap(edges: DataFrame, trials: int = 1, seed: int = 123) -> DataFrame:
    """(node, community) of a greedy search of the two-level map equation."""
    e = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
    return _per_component(e, lambda rows: map_equation_search(rows, trials, seed), names_of(edges).select("node"))


def label_moving(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(node, community) for graphs beyond a task's memory: each round, half of the nodes by hash move to the community with most of
    their weight (own first, then least name)."""
    from laminet.model import symmetrize
    from laminet.session import cut

    both = cut(symmetrize(edges.select("src", "dst", "weight")).where("src <> dst"), "both")
    now = names_of(edges).select("node", F.col("node").alias("community"))
    for k in range(rounds):
        votes = both.join(now.toDF("dst", "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = votes.join(now.toDF("src", "own"), "src").groupBy("src").agg(F.max_by("community", F.struct("w", (F.col("own") == F.col("community")), F.col("community"))).alias("best"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        now = cut(now.join(best, now["node"] == best["src"], "left").select("node", F.when(turn & F.col("best").isNotNull(), F.col("best")).otherwise(F.col("community")).alias("community")), "moved")
    return now


def multiplex_louvain(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community) of layers (edges with src_layer) sharing one partition: each layer's weight is scaled to its own total, so that the
    layers' modularities add up, and the sum is optimised as one graph."""
    total = edges.groupBy("src_layer").agg(F.sum("weight").alias("t"))
    e = edges.join(total, "src_layer").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(F.col("weight") / F.col("t")).alias("weight"))
    return _per_component(e, lambda rows: flatten(louvain_levels(rows, resolution)), names_of(edges).select("node"))


def norc(edges: DataFrame, damping: float = 0.9, threshold: float = 0.0005, candidates: tuple[int, ...] = (1, 3, 5, 7, 11, 20, 40, 50, 100, 200, 300), fine: int = 3, steps: int = 10, seed: int = 1) -> DataFrame:
    """(node, community): personalised PageRank vectors, clustered by k-means for each number of communities; the best modularity is kept and
    numbers about it tried."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from laminet.model import symmetrize
    from laminet.session import cut

    both = symmetrize(edges.select("src", "dst", "weight"))
    ppr = all_ppr(both, damping=damping, steps=steps, threshold=threshold, zero_seeds=False)
    order = names_of(edges).withColumn("i", F.row_number().over(Window.orderBy("node")) - 1)
    n = order.count()
    per = ppr.join(order, "node").groupBy(F.col("seed").alias("node")).agg(F.map_from_entries(F.collect_list(F.struct("i", "rank"))).alias("m"))
    vectors = cut(per.select("node", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("v")), "vectors")
    data = vectors.select("node", array_to_vector("v").alias("features")).persist()
    best, score, tried = None, -1.0, set()

    def attempt(k: int) -> None:
        nonlocal best, score
        if k in tried or not 1 < k < n:
            return
        tried.add(k)
        at = KMeans(k=k, seed=seed).fit(data).transform(data).select("node", F.col("prediction").cast("long").alias("community"))
        q = modularity(edges, at).first()[0]
        if q > score:
            best, score = (k, at), q

    for k in candidates:
        attempt(k)
    if best:
        middle = best[0]
        for k in range(middle - fine, middle + fine + 1):
            attempt(k)
    return renumber(best[1]) if best else names_of(edges).select("node", F.lit(0).cast("long").alias("community"))


def relax_links(edges: DataFrame, rate: float = 0.15) -> DataFrame:
    """(node, layer_a, to, layer_b, p): steps of a walker in layer_a that relaxes at a rate to any of the node's layers by out-weight: weight
    times rate over the node's weight in all layers, and in the same layer also (1 - rate) over its weight there."""
    e = edges.where("src_layer = dst_layer").groupBy("src", F.col("src_layer").alias("layer"), "dst").agg(F.sum("weight").alias("w"))
    own = e.groupBy("src", "layer").agg(F.sum("w").alias("w_layer"))
    every = own.groupBy("src").agg(F.sum("w_layer").alias("w_all"))
    j = e.select("src", F.col("layer").alias("layer_b"), "dst", "w").join(own.select("src", F.col("layer").alias("layer_a"), "w_layer"), "src").join(every, "src")
    p = F.col("w") * (rate / F.col("w_all") + F.when(F.col("layer_a") == F.col("layer_b"), (1 - rate) / F.col("w_layer")).otherwise(0.0))
    return j.select(F.col("src").alias("node"), "layer_a", F.col("dst").alias("to"), "layer_b", p.alias("p"))


def jensen_shannon(edges: DataFrame) -> DataFrame:
    """(node, layer_a, layer_b, divergence) in bits between a node's out-link distributions in two layers."""
    e = edges.where("src_layer = dst_layer").groupBy("src", F.col("src_layer").alias("layer"), "dst").agg(F.sum("weight").alias("w"))
    e = cut(e, "layers")
    total = cut(e.groupBy("src", "layer").agg(F.sum("w").alias("t")), "totals")
    # A link in one layer only adds half its share, so that without common links the divergence is 1; only these are paired.
    links = e.groupBy("src", "dst").agg(F.collect_list(F.struct("layer", "w")).alias("ls")).where(F.size("ls") > 1)
    both = links.select("src", F.explode("ls").alias("x"), "ls").select("src", "x", F.explode("ls").alias("y")).where("x.layer < y.layer")
    both = both.select("src", F.col("x.layer").alias("layer_a"), F.col("y.layer").alias("layer_b"), F.col("x.w").alias("x"), F.col("y.w").alias("y"))
    both = both.join(total.toDF("src", "layer_a", "_a"), ["src", "layer_a"]).join(total.toDF("src", "layer_b", "_b"), ["src", "layer_b"])
    x, y = F.col("x") / F.col("_a"), F.col("y") / F.col("_b")
    d = 0.5 * plogp(x) + 0.5 * plogp(y) - plogp((x + y) / 2) - (x + y) / 2
    common = both.groupBy("src", "layer_a", "layer_b").agg(F.sum(d).alias("d"))
    pairs = total.select("src", F.col("layer").alias("layer_a")).join(total.select("src", F.col("layer").alias("layer_b")), "src").where("layer_a < layer_b")
    out = pairs.join(common, ["src", "layer_a", "layer_b"], "left")
    return out.select(F.col("src").alias("node"), "layer_a", "layer_b", (1 + F.coalesce("d", F.lit(0.0))).alias("divergence"))


def single_linkage(points: DataFrame, k: int, most: int = 3000) -> DataFrame:
    """(node, community) from (node, v array<double>) by cutting a minimum spanning tree into k; refused beyond most points."""
    import numpy as np

    rows = points.select("node", "v").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many points for single linkage")
    x = np.array([r["v"] for r in rows], float)
    n = len(rows)
    inside, dist, via = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    dist[:1] = 0
    tree = []
    for _ in range(n):
        i = int(np.where(inside, np.inf, dist).argmin())
        inside[i] = True
        tree.append((dist[i], i, via[i]))
        d = np.linalg.norm(x - x[i], axis=1)
        via[(d < dist) & ~inside] = i
        dist = np.where(inside, dist, np.minimum(d, dist))
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for _, a, b in sorted(tree[1:])[: max(0, n - k)]:
        up[find(a)] = find(b)
    return points.sparkSession.createDataFrame([(r["node"], find(i)) for i, r in enumerate(rows)], "node string, community long")
