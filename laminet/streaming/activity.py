"""Structured Streaming twins of the temporal operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_activity(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files of temporal edges."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, layer: str = "layer") -> DataFrame:
    """(start, layer, edges) of event-time windows; rows later than `late` behind the newest are dropped."""
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return s.groupBy(F.window("_t", width).alias("_w"), layer).agg(F.count("*").alias("edges")).select(F.col("_w.start").alias("start"), layer, "edges")


def session_counts(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return s.groupBy(key, F.session_window("_t", gap).alias("_w")).agg(F.count("*").alias("edges")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "edges")


def to_table(result: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Runs until all that is there has been read, and writes Parquet (append) exactly once."""
    q = result.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
