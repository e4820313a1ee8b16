"""Random networks, reproducible by seed whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from laminet.model import MultilayerNetwork


def _u(*cols: Column) -> Column:
    return F.xxhash64(*cols) / F.lit(2.0**64) + 0.5


def random_multilayer_er(spark: SparkSession, n: int, layers: int, p: float, seed: int = 1) -> MultilayerNetwork:
    """G(n, p) whose nodes get a layer each at random. All n (n - 1) / 2 pairs are drawn, so n should stay moderate."""
    nodes = spark.range(n).select(F.col("id"), F.floor(_u(F.col("id"), F.lit(seed)) * layers).cast("string").alias("layer"))
    e = _pairs(spark, n, p, seed)
    e = e.join(nodes.toDF("a", "src_layer"), "a").join(nodes.toDF("b", "dst_layer"), "b")
    return MultilayerNetwork.from_edges(e.select(F.col("a").alias("src"), "src_layer", F.col("b").alias("dst"), "dst_layer"), nodes.select(F.col("id").cast("string").alias("node"), "layer"))


def _pairs(spark: SparkSession, n: int, p: float, seed: int):
    ids = spark.range(n).select(F.col("id").alias("a"))
    return ids.select("a", F.explode(F.sequence(F.col("a") + 1, F.lit(n - 1).cast("long"))).alias("b")).where("b > a and b < %d" % n).where(_u(F.col("a"), F.col("b"), F.lit(seed)) < p) if n > 1 else ids.select("a", F.col("a").alias("b")).limit(0)


def random_multiplex_er(spark: SparkSession, n: int, layers: int, p: float, seed: int = 1) -> MultilayerNetwork:
    """An independent G(n, p) for each layer on the same names."""
    out = None
    for k in range(layers):
        e = _pairs(spark, n, p, seed * 1000 + k).select(F.col("a").alias("src"), F.lit(str(k)).alias("src_layer"), F.col("b").alias("dst"), F.lit(str(k)).alias("dst_layer"))
        out = e if out is None else out.union(e)
    return MultilayerNetwork.from_edges(out)


def random_multiplex(spark: SparkSession, n: int, m: int, d: float = 0.9, seed: int = 1) -> MultilayerNetwork:
    """Names belong to each of m layers at random by halves; a layer's members form a clique sampled at rate d."""
    at = spark.range(n).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("layer")).where(_u(F.col("node"), F.col("layer"), F.lit(seed)) < 0.5)
    e = at.toDF("a", "layer").join(at.toDF("b", "layer"), "layer").where("a < b").where(_u(F.col("a"), F.col("b"), F.col("layer"), F.lit(seed + 1)) < d)
    return MultilayerNetwork.from_edges(e.select(F.col("a").alias("src"), F.col("layer").alias("src_layer"), F.col("b").alias("dst"), F.col("layer").alias("dst_layer")))
