"""Sinks: parquet, versioned tables, verified checkpoints, adjacency text, SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feathergrid.session import cut_lineage, scratch_path


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """``mode`` is ``errorifexists`` or ``overwrite``."""
    df.write.mode(mode).parquet(path)
    return path


def write_versioned(df: DataFrame, root: str, version: str) -> str:
    """Write below ``root/version=<version>``; older versions stay readable."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the newest version that was written to its end; no other version is read.

    Versions are compared as numbers if all of them are, else as text.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    for entry in store.listStatus(folder):
        name = entry.getPath().getName()
        committed = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("version=") and store.exists(committed):
            done.append(name.removeprefix("version="))
    if not done:
        raise ValueError(f"{root}: no finished version")
    numbers = all(v.isdigit() for v in done)
    newest = max(done, key=(lambda v: (int(v), v)) if numbers else str)
    return spark.read.parquet(f"{root.rstrip('/')}/version={newest}")


def checkpoint_verified(df: DataFrame, category: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write, re-read and compare: returns the re-read table and the counts by category.

    Raises if any category, null included, has another number of rows than
    before, so a lost row is found too.  (Counting by ``observe`` would leave the
    session with a manager that later closures over it cannot be shipped with.)
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "verified")
    df.write.mode("errorifexists").parquet(path)
    back = spark.read.parquet(path)
    before = df.groupBy(category).agg(F.count(F.lit(1)).alias("rows_before"))
    after = back.groupBy(category).agg(F.count(F.lit(1)).alias("rows_after"))
    same = F.col(f"b.{category}").eqNullSafe(F.col(f"a.{category}"))
    both = before.alias("b").join(after.alias("a"), same, "full_outer").select(
        F.coalesce(f"b.{category}", f"a.{category}").alias(category), "rows_before", "rows_after"
    )
    both = cut_lineage(both)
    if both.where(~F.col("rows_before").eqNullSafe(F.col("rows_after"))).limit(1).count():
        raise ValueError(f"{path}: the rows by {category} differ from those written")
    return back, both


def write_adjacency_text(edges: DataFrame, path: str, per_line: int = 10_000) -> str:
    """Edges to adjacency lines; a node with many links spans several lines of bounded length."""
    degree = edges.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / per_line).alias("_lines"))
    piece = F.pmod(F.xxhash64("dst"), F.col("_lines"))
    entry = F.concat(F.lit("'"), F.col("dst").cast("string"), F.lit("': "), F.col("w").cast("string"))
    lines = (
        edges.join(degree, "src")
        .withColumn("_piece", piece)
        .groupBy("src", "_piece")
        .agg(F.concat_ws(", ", F.collect_list(entry)).alias("body"))
    )
    lines.select(F.concat(F.col("src").cast("string"), F.lit("\t{"), "body", F.lit("}"))).write.text(path)
    return path


def sql_view(df: DataFrame, name: str, text: str) -> DataFrame:
    """Register a view and run SQL text over it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(text)
