"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input that one task of a data-sized shuffle stands for, while there are at most MANY_TASKS; beyond, tasks grow up to LARGE_TASK_BYTES.
TASK_BYTES, MANY_TASKS, LARGE_TASK_BYTES = 2 << 20, 20_000, 256 << 20

#: Spark's setting by which a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else that of the context. Where both are unset a new local one is set, on one machine only; on a cluster that is an error, as its executors share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and held.isDefined():
        return held.get()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-merloom-", dir="/tmp")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read back: it survives lost executors and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/merloom-{label}-{uuid.uuid4().hex}"
    # the shuffle files of this write go as soon as it is done, not when the driver collects its garbage
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that no later plan reads; other DataFrames are left alone."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def exists(table: DataFrame) -> bool:
    """Whether a table that written() made is still there."""
    jvm = table.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(table._written_to)
    return at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(at)


def bytes_of(df: DataFrame) -> float | None:
    """The bytes of df as Catalyst estimates them from its files; none if it can't."""
    size = float(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def tasks_for(df: DataFrame, times: float = 1) -> int:
    """Tasks for a shuffle of about `times` the bytes of df, as far as these are known; at least spark.sql.shuffle.partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = (bytes_of(df) or 0) * times
    return max(least, min(math.ceil(size / TASK_BYTES), MANY_TASKS), math.ceil(size / LARGE_TASK_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where the files give fewer partitions than there are cores (a small table in one file); else as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
