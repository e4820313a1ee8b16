"""Slices and chunks of temporal edges, in rows and in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.session import cut


def numbered(df: DataFrame, order: list[str], out: str = "_n") -> DataFrame:
    """Adds the row's number from 0 in the order (which must be total): ranges are numbered by themselves, after the counts of those before.

    The ranges are written: their bounds come from a sample, and a second reading that drew another would count other ranges than it numbers."""
    d = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    before = d.groupBy("_p").agg(F.count("*").alias("_c"))
    before = before.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return d.join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.col("_k") - 1).drop("_p", "_k", "_b")


def slices(activity: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Adds slice, from 0: n slices of rows in order whose sizes differ by one at most, larger ones first."""
    total = activity.count()
    small, extra = divmod(total, n)
    big = extra * (small + 1)
    i = F.col("_n")
    s = F.floor(i / (small + 1)) if small == 0 else F.when(i < big, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - big) / small))
    return numbered(activity, order).withColumn("slice", s.cast("long")).drop("_n")


def chunks(activity: DataFrame, rows: int, order: list[str]) -> DataFrame:
    """Adds chunk: floor of the row's number over rows."""
    return numbered(activity, order).withColumn("chunk", F.floor(F.col("_n") / rows).cast("long")).drop("_n")


def layer_counts(df: DataFrame, by: str, layer: str = "layer") -> DataFrame:
    return df.groupBy(by, layer).agg(F.count("*").alias("edges"))


def windows(activity: DataFrame, time: str, width: str, slide: str | None = None, layer: str = "layer") -> DataFrame:
    """(start, layer, edges) of event-time windows; works on streams too."""
    w = F.window(F.col(time).cast("timestamp"), width, slide) if slide else F.window(F.col(time).cast("timestamp"), width)
    return activity.groupBy(w.alias("_w"), layer).agg(F.count("*").alias("edges")).select(F.col("_w.start").alias("start"), layer, "edges")


def sessions(activity: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, start, end, edges): runs of events less than gap apart."""
    w = F.session_window(F.col(time).cast("timestamp"), gap)
    return activity.groupBy(key, w.alias("_w")).agg(F.count("*").alias("edges")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "edges")


def edges_of(activity: DataFrame) -> DataFrame:
    """Intra-layer edges of temporal rows (node_first, node_second, layer)."""
    return activity.select(F.col("node_first").cast("string").alias("src"), F.col("layer").alias("src_layer"), F.col("node_second").cast("string").alias("dst"), F.col("layer").alias("dst_layer"), F.lit("default").alias("etype"), F.lit(1.0).alias("weight"))


def layer_visits(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """(walker, step, layers): the layers of the node a walker visits at each step."""
    at = nodes.groupBy("node").agg(F.sort_array(F.collect_set("layer")).alias("layers"))
    return path.join(at, "node").select("walker", "step", "layers")
