"""The data model: a network is a table of node-layers and a table of edges, and a frozen configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_COLUMNS = ["src", "src_layer", "dst", "dst_layer", "etype", "weight"]
NODE_COLUMNS = ["node", "layer"]
#: Edge types that join the replicas of one name.
COUPLING_TYPES = ("coupling", "mpx")


@dataclass(frozen=True)
class NetConfig:
    directed: bool = False
    network_type: str = "multilayer"
    dummy_layer: str = "null"
    label_delimiter: str = "---"
    coupling_weight: float = 1.0


def edge_table(df: DataFrame) -> DataFrame:
    """df with the edge columns in order, missing ones at their defaults, names and layers as strings; others dropped but attrs."""
    have = set(df.columns)
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in have else F.lit(default)
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)) if "weight" in have else F.lit(1.0)
    cols = [F.col("src").cast("string"), text("src_layer", "null").alias("src_layer"), F.col("dst").cast("string"), text("dst_layer", "null").alias("dst_layer"), text("etype", "default").alias("etype"), weight.alias("weight")]
    return df.select(*cols, *(["attrs"] if "attrs" in have else []))


def endpoints(edges: DataFrame) -> DataFrame:
    """A row (node, layer) for each end of each edge; a self loop has two."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("src_layer").alias("layer")), F.struct(F.col("dst").alias("node"), F.col("dst_layer").alias("layer")))).alias("e")).select("e.node", "e.layer")


@dataclass(frozen=True)
class MultilayerNetwork:
    """edges: EDGE_COLUMNS (and attrs); nodes: NODE_COLUMNS, one row each, with any attribute columns."""

    edges: DataFrame
    nodes: DataFrame
    config: NetConfig = field(default_factory=NetConfig)

    @staticmethod
    def from_edges(df: DataFrame, nodes: DataFrame | None = None, config: NetConfig | None = None) -> MultilayerNetwork:
        edges = edge_table(df)
        ends = endpoints(edges).distinct()
        return MultilayerNetwork(edges, ends if nodes is None else nodes.unionByName(ends, allowMissingColumns=True).dropDuplicates(NODE_COLUMNS), config or NetConfig())

    @staticmethod
    def empty(spark: SparkSession, config: NetConfig | None = None) -> MultilayerNetwork:
        kinds = "src string, src_layer string, dst string, dst_layer string, etype string, weight double"
        return MultilayerNetwork(spark.createDataFrame([], kinds), spark.createDataFrame([], "node string, layer string"), config or NetConfig())

    def with_(self, **changes) -> MultilayerNetwork:
        return replace(self, **changes)

    # Access

    def get_edges(self, coupling: bool = True) -> DataFrame:
        """All edges, or without those that couple replicas."""
        return self.edges if coupling else self.edges.where(~F.col("etype").isin(*COUPLING_TYPES))

    def get_nodes(self) -> DataFrame:
        return self.nodes

    def get_edge(self, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
        there = _ends(src, "src") & _ends(dst, "dst")
        return self.edges.where(there if self.config.directed else there | (_ends(src, "dst") & _ends(dst, "src")))

    def get_neighbors(self, node: str, layer: str) -> DataFrame:
        """Distinct (node, layer) next to it: where its edges lead, and where they come from unless directed."""
        out = self.edges.where(_ends((node, layer), "src")).select(F.col("dst").alias("node"), F.col("dst_layer").alias("layer"))
        if not self.config.directed:
            out = out.union(self.edges.where(_ends((node, layer), "dst")).select("src", "src_layer"))
        return out.distinct()


def _ends(at: tuple[str, str], side: str) -> Column:
    return (F.col(side) == at[0]) & (F.col(f"{side}_layer") == at[1])


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, a self loop once."""
    turned = edges.withColumns({"src": F.col("dst"), "dst": F.col("src"), "src_layer": F.col("dst_layer"), "dst_layer": F.col("src_layer")}) if "src_layer" in edges.columns else edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    loop = (F.col("src") == F.col("dst")) & ((F.col("src_layer") == F.col("dst_layer")) if "src_layer" in edges.columns else F.lit(True))
    return edges.unionByName(turned.where(~loop))
