"""Connected components by alternating large and small stars, with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminet.llm.common import cut, discard


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours in pairs (u, v)."""
    return pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))


def components(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long), each direction or both. Returns (id, component): each id of an edge, and the least it reaches.

    Every round hangs each node's larger neighbours on its least neighbour, then each node and its smaller ones; nothing
    is gathered but minima, and the number of edges never grows beyond the nodes and edges given. The rounds end when
    only stars about the least ids are left.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        old, large = now, cut(large.where("u <> v").distinct(), "large")
        small = large.join(_least(large), F.col("u") == F.col("_u"))
        small = small.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(small.select("u", F.col("_m").alias("v")))
        now = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        discard(old, large)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
