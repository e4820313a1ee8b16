"""Selection, mutation, set operations, coupling and aggregation of multilayer networks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.model import COUPLING_TYPES, EDGE_COLUMNS, MultilayerNetwork, edge_table, endpoints
from laminet.operators.temporal import numbered
from laminet.session import cut

SRC, DST = ["src", "src_layer"], ["dst", "dst_layer"]
ENDS = [*SRC, *DST]


def _both(edges: DataFrame, keep: DataFrame, cols: list[str], on: list[str]) -> DataFrame:
    """Edges both ends of which are in keep (cols); on: the part of an end that is compared."""
    for side in ("src", "dst"):
        names = [side if c == "node" else f"{side}_layer" for c in on]
        edges = edges.join(keep.select(*[F.col(c).alias(n) for c, n in zip(cols, names)]).distinct(), names, "left_semi")
    return edges


# Selection


def subnetwork_layers(net: MultilayerNetwork, layers: Iterable[str]) -> MultilayerNetwork:
    layers = list(layers)
    return MultilayerNetwork(net.edges.where(F.col("src_layer").isin(layers) & F.col("dst_layer").isin(layers)), net.nodes.where(F.col("layer").isin(layers)), net.config)


def subnetwork_names(net: MultilayerNetwork, names: DataFrame) -> MultilayerNetwork:
    """names: a table with the column node."""
    return MultilayerNetwork(_both(net.edges, names, ["node"], ["node"]), net.nodes.join(names.select("node").distinct(), "node", "left_semi"), net.config)


def subnetwork_pairs(net: MultilayerNetwork, pairs: DataFrame) -> MultilayerNetwork:
    """pairs: a table with the columns node and layer."""
    return MultilayerNetwork(_both(net.edges, pairs, ["node", "layer"], ["node", "layer"]), net.nodes.join(pairs.select("node", "layer").distinct(), ["node", "layer"], "left_semi"), net.config)


def intra_layer(edges: DataFrame) -> DataFrame:
    return edges.where("src_layer = dst_layer")


def inter_layer(edges: DataFrame) -> DataFrame:
    """Edges between layers, etype `default_inter` where they have none."""
    return edges.where("src_layer <> dst_layer").withColumn("etype", F.when(F.coalesce("etype", F.lit("")).isin("", "default"), "default_inter").otherwise(F.col("etype")))


def inter_layer_by_type(edges: DataFrame) -> DataFrame:
    return inter_layer(edges).groupBy("etype", "src_layer", "dst_layer").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


def split_to_layers(net: MultilayerNetwork, layers: Iterable[str]) -> tuple[dict[str, MultilayerNetwork], DataFrame]:
    """A network for each layer named, and the edges between layers."""
    own = intra_layer(net.edges)
    return {k: MultilayerNetwork(own.where(F.col("src_layer") == k), net.nodes.where(F.col("layer") == k), net.config) for k in layers}, inter_layer(net.edges)


def remove_layer_edges(net: MultilayerNetwork) -> MultilayerNetwork:
    return net.with_(edges=net.edges.limit(0))


def isolates(net: MultilayerNetwork) -> DataFrame:
    return net.nodes.join(endpoints(net.edges).distinct(), ["node", "layer"], "left_anti")


def remove_isolates(net: MultilayerNetwork) -> MultilayerNetwork:
    return net.with_(nodes=net.nodes.join(endpoints(net.edges).distinct(), ["node", "layer"], "left_semi"))


def simple_edges(edges: DataFrame, directed: bool = False, order: Column | None = None) -> DataFrame:
    """One edge for each pair of ends; the attributes of the last by order (the heaviest if None)."""
    if not directed:
        edges = canonical(edges)
    last = F.struct((order if order is not None else F.col("weight")).alias("_o"), F.col("etype"), F.col("weight"))
    out = edges.groupBy(*ENDS).agg(F.max(last).alias("_l"))
    return out.select(*ENDS, F.col("_l.etype").alias("etype"), F.col("_l.weight").alias("weight"))


def canonical(edges: DataFrame) -> DataFrame:
    """Ends in ascending order."""
    a, b = F.struct("src", "src_layer"), F.struct(F.col("dst").alias("src"), F.col("dst_layer").alias("src_layer"))
    low, high = F.least(a, b), F.greatest(a, b)
    rest = [c for c in edges.columns if c not in ENDS]
    return edges.select(low["src"].alias("src"), low["src_layer"].alias("src_layer"), high["src"].alias("dst"), high["src_layer"].alias("dst_layer"), *rest)


# Mutation


def add_edges(net: MultilayerNetwork, more: DataFrame) -> MultilayerNetwork:
    """more: edge columns, those missing at their defaults (missing layers: the dummy layer)."""
    more = edge_table(more.fillna(net.config.dummy_layer, [c for c in ("src_layer", "dst_layer") if c in more.columns]))
    return net.with_(edges=net.edges.unionByName(more, allowMissingColumns=True), nodes=net.nodes.unionByName(endpoints(more), allowMissingColumns=True).dropDuplicates(["node", "layer"]))


def add_edge_rows(net: MultilayerNetwork, rows: list[dict] | list[list]) -> MultilayerNetwork:
    """Dictionaries (source, target, source_type, target_type, type, weight) or lists [n1, l1, n2, l2, w]."""
    spark = net.edges.sparkSession
    out = []
    for r in rows:
        if isinstance(r, dict):
            out.append((r["source"], r.get("source_type"), r["target"], r.get("target_type"), r.get("type"), r.get("weight")))
        else:
            out.append((r[0], r[1], r[2], r[3], None, r[4] if len(r) > 4 else None))
    text = lambda v: None if v is None else str(v)
    rows = [tuple(map(text, r[:5])) + (None if r[5] is None else float(r[5]),) for r in out]
    return add_edges(net, spark.createDataFrame(rows, "src string, src_layer string, dst string, dst_layer string, etype string, weight double"))


def remove_edges(edges: DataFrame, gone: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Takes out as many parallel edges as gone lists of each (lightest first)."""
    keys = keys or ENDS
    many = gone.groupBy(*keys).agg(F.count("*").alias("_many"))
    numbered = edges.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("weight", "etype")))
    return numbered.join(many, keys, "left").where(F.col("_rn") > F.coalesce("_many", F.lit(0))).select(*edges.columns)


def add_nodes(net: MultilayerNetwork, more: DataFrame) -> MultilayerNetwork:
    if "layer" not in more.columns:
        more = more.withColumn("layer", F.lit(net.config.dummy_layer))
    return net.with_(nodes=net.nodes.unionByName(more, allowMissingColumns=True).dropDuplicates(["node", "layer"]))


def remove_nodes(net: MultilayerNetwork, gone: DataFrame) -> MultilayerNetwork:
    """Drops the (node, layer) rows and all edges at them."""
    gone = gone.select("node", "layer").distinct()
    edges = net.edges
    for names in (SRC, DST):
        edges = edges.join(gone.toDF(*names), names, "left_anti")
    return net.with_(edges=edges.select(*net.edges.columns), nodes=net.nodes.join(gone, ["node", "layer"], "left_anti"))


def add_dummy_layers(df: DataFrame, layer: str = "null") -> DataFrame:
    return df.withColumns({"src_layer": F.lit(layer), "dst_layer": F.lit(layer)})


# Set operations


def merge(a: MultilayerNetwork, b: MultilayerNetwork) -> MultilayerNetwork:
    return a.with_(edges=a.edges.unionByName(b.edges, allowMissingColumns=True), nodes=a.nodes.unionByName(b.nodes, allowMissingColumns=True).dropDuplicates(["node", "layer"]))


def layer_intersection(nodes: DataFrame, layers: Iterable[str]) -> DataFrame:
    """Names that occur in each of the layers."""
    layers = list(layers)
    return nodes.where(F.col("layer").isin(layers)).select("node", "layer").distinct().groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") == len(layers)).select("node")


def edge_difference(edges: DataFrame, keep: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ENDS
    return edges.select(*keys).distinct().join(keep.select(*keys).distinct(), keys, "left_anti")


# Coupling


def coupling_existing(nodes: DataFrame, etype: str = "mpx", weight: float = 1.0) -> DataFrame:
    """One edge for each unordered pair of layers in which a name occurs."""
    n = nodes.select("node", "layer").distinct()
    a, b = n.select("node", F.col("layer").alias("src_layer")), n.select("node", F.col("layer").alias("dst_layer"))
    out = a.join(b, "node").where("src_layer < dst_layer")
    return out.select(F.col("node").alias("src"), "src_layer", F.col("node").alias("dst"), "dst_layer", F.lit(etype).alias("etype"), F.lit(weight).alias("weight"))


def coupling_full(nodes: DataFrame, weight: float = 1.0) -> DataFrame:
    """Edges for all ordered pairs of layers at every name, replicas made where missing. Layers come as one array, whose
    number the result grows with in any case."""
    layers = nodes.select("layer").distinct().agg(F.sort_array(F.collect_set("layer")).alias("ls"))
    names = nodes.select("node").distinct().withColumn("_k", F.lit(0)).join(F.broadcast(layers.withColumn("_k", F.lit(0))), "_k")
    out = names.select("node", F.explode("ls").alias("src_layer"), "ls").select("node", "src_layer", F.explode("ls").alias("dst_layer")).where("src_layer <> dst_layer")
    return out.select(F.col("node").alias("src"), "src_layer", F.col("node").alias("dst"), "dst_layer", F.lit("coupling").alias("etype"), F.lit(weight).alias("weight"))


def couple(net: MultilayerNetwork, mode: str = "existing") -> MultilayerNetwork:
    if mode not in ("existing", "full"):
        raise ValueError(f"no coupling mode {mode!r}")
    new = coupling_existing(net.nodes, "coupling", net.config.coupling_weight) if mode == "existing" else coupling_full(net.nodes, net.config.coupling_weight)
    return net.with_(edges=net.edges.unionByName(new, allowMissingColumns=True), nodes=net.nodes.unionByName(endpoints(new), allowMissingColumns=True).dropDuplicates(["node", "layer"]))


def line_graph(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs (a, b) of undirected edges, a < b, that meet at a node (through). most: leaves out nodes of more edges."""
    e = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    e = e.withColumn("edge", F.concat_ws("~", "x", "y"))
    at = e.select("edge", F.explode(F.array_distinct(F.array("x", "y"))).alias("through"))
    if most is not None:
        at = at.withColumn("_d", F.count("*").over(Window.partitionBy("through"))).where(F.col("_d") <= most).drop("_d")
    return at.toDF("a", "through").join(at.toDF("b", "through"), "through").where("a < b").select("through", "a", "b")


# Aggregation


def degrees(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Degrees of node-layers (or by other columns of the ends), parallel edges counted each and self loops twice."""
    by = by or ["node", "layer"]
    return endpoints(edges).groupBy(*by).agg(F.count("*").alias("degree"))


def summary(net: MultilayerNetwork) -> DataFrame:
    n = net.nodes.agg(F.countDistinct("layer").alias("layers"), F.count("*").alias("node_layers"), F.countDistinct("node").alias("names"))
    e = net.edges.agg(F.count("*").alias("edges"))
    return n.withColumn("_k", F.lit(0)).join(e.withColumn("_k", F.lit(0)), "_k").drop("_k").withColumn("mean_degree", 2 * F.col("edges") / F.col("node_layers"))


def entity_counts(net: MultilayerNetwork) -> DataFrame:
    """Distinct edges and distinct node-layers with outgoing edges."""
    return net.edges.agg(F.countDistinct(*ENDS).alias("unique_edges"), F.countDistinct(*SRC).alias("unique_sources"))


def layer_stats(net: MultilayerNetwork) -> DataFrame:
    n = net.nodes.groupBy("layer").agg(F.count("*").alias("nodes"))
    e = intra_layer(net.edges).groupBy(F.col("src_layer").alias("layer")).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    return n.join(e, "layer", "left").fillna({"edges": 0, "weight": 0.0}).withColumn("mean_degree", 2 * F.col("edges") / F.col("nodes"))


#: Normalisers of aggregate_edges: the mean over a layer's nodes that its edges count by.
NORMALISERS = ("degree", "in_degree", "out_degree", "raw")


def aggregate_edges(net: MultilayerNetwork, normalize_by: str = "degree") -> DataFrame:
    """Layers collapsed: (src, dst, weight), the sum over intra-layer edges of 1/c of their layer, where c is the layer's mean
    degree (in or out degree), or of 1 for raw. Coupling is left out; pairs are in ascending order unless directed."""
    if normalize_by not in NORMALISERS:
        raise ValueError(f"no normaliser {normalize_by!r}")
    edges = intra_layer(net.get_edges(coupling=False))
    pair = ["src", "dst"]
    per = edges.select(*(pair if net.config.directed else [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]), F.col("src_layer").alias("layer"))
    per = per.groupBy("src", "dst", "layer").agg(F.count("*").alias("n"))
    if normalize_by == "raw":
        return per.groupBy(*pair).agg(F.sum("n").cast("double").alias("weight"))
    ends = 2 if normalize_by == "degree" else 1
    m = per.groupBy("layer").agg(F.sum("n").alias("m"))
    scale = net.nodes.groupBy("layer").agg(F.count("*").alias("k")).join(m, "layer").select("layer", (F.col("k") / (ends * F.col("m"))).alias("scale"))
    # A row for each layer is sent to all tasks: a join by layer would bring a whole layer's pairs into one.
    return per.join(F.broadcast(scale), "layer").groupBy(*pair).agg(F.sum(F.col("n") * F.col("scale")).alias("weight"))


def top_hubs(edges: DataFrame, top: int = 100, layer: str | None = None) -> DataFrame:
    """The node-layers of highest degree; ties by name and layer."""
    d = degrees(edges)
    d = d if layer is None else d.where(F.col("layer") == layer)
    return d.orderBy(F.desc("degree"), "node", "layer").limit(top)


def occurrence(edges: DataFrame) -> DataFrame:
    """(layer_a, layer_b, r, c): r counts the ordered pairs of ends that both layers have (on the diagonal a layer's edges), c divides it
    by the number of all distinct pairs and one (diagonal), or by the count of layer_b."""
    e = intra_layer(edges).select("src", "dst", F.col("src_layer").alias("layer"))
    own = e.groupBy("layer").agg(F.count("*").alias("r"))
    pairs = e.groupBy("src", "dst").agg(F.sort_array(F.collect_set("layer")).alias("ls"))
    total = pairs.agg((F.count("*") + 1).alias("pairs"))
    both = pairs.where(F.size("ls") > 1).select(F.explode("ls").alias("layer_a"), "ls").select("layer_a", F.explode("ls").alias("layer_b")).where("layer_a <> layer_b").groupBy("layer_a", "layer_b").agg(F.count("*").alias("r"))
    off = both.join(own.select(F.col("layer").alias("layer_b"), F.col("r").alias("rb")), "layer_b").select("layer_a", "layer_b", "r", (F.col("r") / F.col("rb")).alias("c"))
    diagonal = own.withColumn("_k", F.lit(0)).join(F.broadcast(total.withColumn("_k", F.lit(0))), "_k").select(F.col("layer").alias("layer_a"), F.col("layer").alias("layer_b"), "r", (F.col("r") / F.col("pairs")).alias("c"))
    return diagonal.unionByName(off)


def entanglement(c: DataFrame) -> list[dict]:
    """Blocks of layers that occur together, with intensity, homogeneity and normalised homogeneity of each. c: as from
    occurrence(); the matrix is layers by layers and so goes to the driver."""
    import numpy as np

    rows = c.collect()
    layers = sorted({r["layer_a"] for r in rows} | {r["layer_b"] for r in rows})
    at = {k: i for i, k in enumerate(layers)}
    m = np.zeros((len(layers), len(layers)))
    for r in rows:
        m[at[r["layer_a"]], at[r["layer_b"]]] = r["c"]
    left, out = set(range(len(layers))), []
    while left:
        block, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i not in block:
                block.add(i)
                todo += [j for j in left if m[i, j] > 0 or m[j, i] > 0]
        left -= block
        ids = sorted(block)
        values, vectors = np.linalg.eig(m[np.ix_(ids, ids)])
        k = int(np.argmax(values.real))
        v = np.abs(vectors[:, k].real)
        cosine = min(1.0, float(v.sum() / (np.linalg.norm(v) * np.sqrt(len(ids)))))
        out.append({"layers": [layers[i] for i in ids], "intensity": float(values[k].real) / len(ids), "homogeneity": cosine, "normalized": 1 - float(np.arccos(cosine)) / (np.pi / 2)})
    return out


def encode(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with dense integer codes from 0 for names and layers in ascending order, and both dictionaries."""
    names = _codes(edges.select(F.explode(F.array("src", "dst")).alias("name")), "name")
    layers = _codes(edges.select(F.explode(F.array("src_layer", "dst_layer")).alias("layer")), "layer")
    out = edges
    for col, d, key in (("src", names, "name"), ("dst", names, "name"), ("src_layer", layers, "layer"), ("dst_layer", layers, "layer")):
        out = out.join(d.select(F.col(key).alias(col), F.col("code").alias(f"{col}_code")), col)
    return out.select("src_code", "src_layer_code", "dst_code", "dst_layer_code", "weight"), names, layers


def _codes(df: DataFrame, key: str) -> DataFrame:
    """Dense codes of the distinct keys in ascending order."""
    return numbered(df.distinct(), [key], "code").select(key, F.col("code").cast("long").alias("code"))


# Matrices


def node_index(net: MultilayerNetwork) -> DataFrame:
    """(node, layer, i): dense numbers from 0, by name as a number where it is one, else as text, then layer."""
    keyed = net.nodes.select("node", "layer").distinct().withColumn("_o", F.struct(F.coalesce(F.col("node").try_cast("double"), F.lit(float("inf"))).alias("n"), F.col("node").alias("t"), F.col("layer").alias("l")))
    return _codes(keyed.select("_o"), "_o").select(F.col("_o.t").alias("node"), F.col("_o.l").alias("layer"), F.col("code").alias("i"))


def supra_adjacency(net: MultilayerNetwork, coupling: bool = False, index: DataFrame | None = None) -> DataFrame:
    """(i, j, v) of the supra-adjacency matrix; parallel edges: the heaviest; both directions unless directed. coupling: with
    the coupling weight between the replicas of each name."""
    own = index is None
    index = cut(node_index(net), "index") if own else index
    edges = net.get_edges(coupling=False) if coupling else net.edges
    e = edges.select(*ENDS, "weight").join(index.toDF("src", "src_layer", "i"), SRC).join(index.toDF("dst", "dst_layer", "j"), DST).select("i", "j", "weight")
    if coupling:
        # Replicas are numbered already where the index is the network's own.
        there = index if own else index.join(net.nodes.select("node", "layer").distinct(), ["node", "layer"], "left_semi")
        a, b = there.select("node", F.col("layer").alias("_a"), "i"), there.select("node", F.col("layer").alias("_b"), F.col("i").alias("j"))
        e = e.union(a.join(b, "node").where("_a < _b").select("i", "j", F.lit(net.config.coupling_weight).alias("weight")))
    if net.config.directed:
        return e.groupBy("i", "j").agg(F.max("weight").alias("v"))
    e = e.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.max("weight").alias("v"))
    turned = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return e.select(F.explode(turned).alias("_e"), "v").select("_e.i", "_e.j", "v")


def tensor(net: MultilayerNetwork) -> DataFrame:
    """(src, src_layer, dst, dst_layer, v) with codes for names and layers."""
    coded, _, _ = encode(net.edges)
    return coded.groupBy("src_code", "src_layer_code", "dst_code", "dst_layer_code").agg(F.max("weight").alias("v"))


def dense(matrix: DataFrame, n: int, most: int = 4096):
    """A NumPy matrix on the driver, refused beyond most rows."""
    import numpy as np

    if n > most:
        raise ValueError(f"{n} rows are too many for a dense matrix; limit {most}")
    out = np.zeros((n, n))
    for i, j, v in matrix.collect():
        out[i, j] = v
    return out


__all__ = [n for n in dir() if not n.startswith("_")]
assert EDGE_COLUMNS and COUPLING_TYPES
