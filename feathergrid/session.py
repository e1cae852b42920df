"""Session settings, the shared checkpoint folder and table access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("feathergrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FEATHERGRID_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="feathergrid-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written by a job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucketed(df: DataFrame, keys: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """``df`` written below the shared folder, bucketed and sorted by ``keys``: joins on them read it without a shuffle."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = f"{name}_{uuid.uuid4().hex}"
    out = df.repartition(n, *keys).write.format("parquet").option("path", scratch_path(spark, name))
    out.bucketBy(n, *keys).sortBy(*keys).saveAsTable(known)
    return spark.table(known)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete files of a finished step wherever they are."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """A scan for heavy work per row, over at least as many partitions as there are cores.

    A big table already has enough splits and is not moved; only a file too
    small to be split is dealt out by ``key``.  Meant for a scan without shuffles.
    With ``rows``, a count first, so that a partition holds about that many at most.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        parts = max(parts, -(-df.count() // rows))
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < parts else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
