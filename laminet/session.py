"""Session helpers shared by tests, the bench and scripts."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("laminet")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster, whose
    executors would each write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="laminet-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Spark's setting by which an execution deletes its shuffle files when it has ended, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: lineage ends there and any executor can read it. The shuffle files
    behind it go at once, for nothing reads them again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


#: Bytes of input files, as they lie on the disk, for a task of a shuffle that wide() makes.
TASK_BYTES = 2 << 20


def wide(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into more parts than the session's shuffles have, where the files behind it need them, so that a task's share stays the
    same as they grow; else df as it is. Tables that aren't read from files don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size())]
    parts = math.ceil(sum(b for b in sizes if b < 1 << 60) / TASK_BYTES)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def discard(*frames: DataFrame | None) -> None:
    """Deletes the tables that cut() wrote for these frames, once nothing that is still to run reads them."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
