"""Writers of networks and results."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminet.model import MultilayerNetwork
from laminet.operators.network import encode, node_index


def _lines(df: DataFrame, cols: list, sep: str, path: str) -> None:
    df.select(F.concat_ws(sep, *cols).alias("value")).write.mode("overwrite").text(path)


def multiedgelist(net: MultilayerNetwork, path: str) -> None:
    """n1 l1 n2 l2 w, tab separated."""
    _lines(net.edges, ["src", "src_layer", "dst", "dst_layer", F.col("weight").cast("string")], "\t", path)


def multiedgelist_encoded(net: MultilayerNetwork, path: str) -> tuple[DataFrame, DataFrame]:
    """As codes; returns the dictionaries of names and layers."""
    coded, names, layers = encode(net.edges)
    _lines(coded, [F.col(c).cast("string") for c in coded.columns], "\t", path)
    return names, layers


def numeric(net: MultilayerNetwork) -> tuple[DataFrame, DataFrame]:
    """Edges (i, j, weight) of node-layer numbers, and the index (node, layer, i)."""
    ix = node_index(net)
    e = net.edges.join(ix.toDF("src", "src_layer", "i"), ["src", "src_layer"]).join(ix.toDF("dst", "dst_layer", "j"), ["dst", "dst_layer"])
    return e.select("i", "j", "weight"), ix


def edgelist(net: MultilayerNetwork, path: str) -> DataFrame:
    """Pairs of numbers; returns the index."""
    e, ix = numeric(net)
    _lines(e, [F.col("i").cast("string"), F.col("j").cast("string")], " ", path)
    return ix


def save_native(net: MultilayerNetwork, path: str) -> None:
    """Parquet, edges by source layer so that layers can be skipped, and the configuration."""
    net.edges.withColumn("layer_part", F.col("src_layer")).write.mode("overwrite").partitionBy("layer_part").parquet(f"{path}/edges")
    net.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    net.nodes.sparkSession.createDataFrame([(json.dumps(asdict(net.config)),)], "config string").write.mode("overwrite").parquet(f"{path}/config")


def json_lines(net: MultilayerNetwork, path: str) -> None:
    """Node-link records, one a line: nodes and links."""
    net.nodes.select(F.to_json(F.struct(F.struct("node", "layer").alias("id"))).alias("value")).write.mode("overwrite").text(f"{path}/nodes")
    net.edges.select(F.to_json(F.struct(F.struct(F.col("src"), F.col("src_layer")).alias("source"), F.struct(F.col("dst"), F.col("dst_layer")).alias("target"), "etype", "weight")).alias("value")).write.mode("overwrite").text(f"{path}/links")


def tree(partition: DataFrame, flow: DataFrame, path: str) -> None:
    """module:rank flow "name" lines from (node, community) and (node, flow)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("community").orderBy(F.desc("flow"), "node")
    rows = partition.join(flow, "node").withColumn("k", F.row_number().over(w))
    _lines(rows, [F.concat_ws(":", F.col("community").cast("string"), F.col("k").cast("string")), F.col("flow").cast("string"), F.concat(F.lit('"'), "node", F.lit('"'))], " ", path)


def clu(partition: DataFrame, path: str) -> None:
    _lines(partition, ["node", F.col("community").cast("string")], " ", path)


def pajek(net: MultilayerNetwork, path: str) -> None:
    e, ix = numeric(net)
    _lines(ix, [(F.col("i") + 1).cast("string"), F.concat(F.lit('"'), "node", F.lit("@"), "layer", F.lit('"'))], " ", f"{path}/vertices")
    _lines(e, [(F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("weight").cast("string")], " ", f"{path}/edges")


def triples(partition: DataFrame, annotations: DataFrame, base: str = "urn:net:") -> DataFrame:
    """(s, p, o): examples of class <community>_community, annotated by their terms. partition (node, community), annotations (entity, term)."""
    uri = lambda c: F.concat(F.lit(base), F.regexp_replace(c, r"[\s\\]", "_"))
    cls = partition.select(uri(F.col("node")).alias("s"), F.lit(base + "class").alias("p"), F.concat(F.lit(base), F.col("community").cast("string"), F.lit("_community")).alias("o"))
    ann = annotations.join(partition.select(F.col("node").alias("entity")), "entity", "left_semi").select(uri(F.col("entity")).alias("s"), F.lit(base + "annotated_by").alias("p"), uri(F.col("term")).alias("o"))
    return cls.union(ann.distinct())


def latex(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A table for print of a result of few rows; more than `most` raise."""
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a table for print of more than {most} rows")
    rows = [" & ".join(cell(v) for v in r) + r" \\" for r in found]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", " & ".join(map(cell, df.columns)) + r" \\ \hline", *rows, r"\end{tabular}"])


SAVERS = {"multiedgelist": multiedgelist, "multiedgelist_encoded": multiedgelist_encoded, "edgelist": edgelist, "native": save_native, "json": json_lines, "pajek": pajek}


def save_network(net: MultilayerNetwork, path: str, output_type: str):
    if output_type not in SAVERS:
        raise ValueError(f"no output type {output_type!r}; there are {', '.join(sorted(SAVERS))}")
    return SAVERS[output_type](net, path)
