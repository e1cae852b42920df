"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table with one row per distinct normalised text, bucketed and
sorted by the text's SHA-256.  New documents are reduced to digests, one row
per new digest (map-side first, so thousands of copies shuffle as one row per
task), sort-merge anti-joined against the index and appended to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import fresh_name, own_names, written


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of ASCII white space as one space; null as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", " ").cast("binary"), 256)


class DigestIndex:
    """A bucketed table ``digest, keep_id, keep_row, batch`` at ``path``, sorted by digest within each bucket.

    ``path`` must be reachable from all executors; opening an existing path
    goes on with what earlier batches have stored there.
    """

    SCHEMA = "digest STRING, keep_id BIGINT, keep_row BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the table's name in the catalog; the index at ``path`` stays, and so do results of ``add``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, documents: DataFrame, batch: str | None = None) -> DataFrame:
        """Take in a batch (columns ``doc_id``, ``text``); return a decision per row.

        ``batch`` names this input.  A job that died can be repeated with the same
        name and the same rows: texts it had already indexed under that name count
        as its own, so the decisions are those of the first time.  Without a name
        every call is another batch.

        Result: ``doc_id, row, text_sha256, keep_id, group_size, kept``.  Of equal
        texts the one already indexed stays; else the row with the smallest
        ``doc_id``, null ids last, and of repeated rows with that id exactly one
        (the first by ``row``).  ``group_size`` counts the rows of this batch with
        that text, ``row`` is the row's number in the batch as scanned.  Null texts
        count as empty.  An empty batch gives no rows and leaves the index alone.
        """
        batch = batch or uuid.uuid4().hex
        rows = written(
            own_names(documents, "doc_id", "text").select(
                "doc_id", F.monotonically_increasing_id().alias("row"), text_digest(F.col("text")).alias("digest")
            ),
            "digests",
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
        groups = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
        new = groups.join(self.table().select("digest"), "digest", "left_anti").select(
            "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.lit(batch).alias("batch")
        )
        sizes = written(groups.select("digest", "group_size"), "digest-sizes")
        (
            new.repartition(self.buckets, "digest").write.format("parquet").mode("append")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )
        # Read as plain files: both sides are then exchanged, so that a digest with a third of all rows is split.
        indexed = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        decided = written(indexed.join(sizes, "digest"), "digest-groups")
        return rows.join(decided, "digest").select(
            "doc_id",
            "row",
            F.col("digest").alias("text_sha256"),
            "keep_id",
            "group_size",
            ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        )


def drop_copies(documents: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``documents`` whose text is new, one per text, with all their columns; ``batch`` as in ``add``.

    ``documents`` must give the same rows in the same order each time it is read
    (a table, not a shuffled query): rows are told apart by their place in it.
    """
    own = index is None
    index = index or DigestIndex(documents.sparkSession)
    dropped = index.add(documents, batch).where("NOT kept").select("row")
    if own:
        index.close()
    row = fresh_name(documents, "row")
    placed = documents.withColumn(row, F.monotonically_increasing_id())
    return placed.join(dropped.withColumnRenamed("row", row), row, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
