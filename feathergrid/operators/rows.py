"""Sort, limit, sample, union, dedup and numbering of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feathergrid.operators.ordered import join_groups
from feathergrid.session import cut_lineage

# fixed value: airports up to this rank are hubs
HUB_RANK = 15


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """k first rows: every task keeps k, so only k rows per task meet in the end."""
    return df.orderBy(*order).limit(k)


def seeded_hash(cols: Sequence[str], seed: int) -> Column:
    """Same text hash on every engine, so a split or sample can be repeated anywhere."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_n(df: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly n rows without replacement: the n smallest seeded hashes."""
    return df.orderBy(seeded_hash(key, seed), *key).limit(n)


def sample_about(df: DataFrame, n: int, seed: int) -> DataFrame:
    """About n rows in one pass after a count."""
    total = df.count()
    return df.sample(False, min(1.0, n / total) if total else 0.0, seed)


def sort_within_entity(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of an entity in order and side by side.

    Range partitioning on (entity, order) splits a hot entity over tasks, and the
    partitions follow each other, which hashing on the entity alone cannot do.
    """
    return df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``: an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def count_distinct_by(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], error: float | None = None
) -> DataFrame:
    """Exact distinct counts: values are made distinct per (key, value) first, which spreads a hot key.

    With ``error`` given, sketches of that relative error in one pass instead.
    """
    if error is not None:
        return df.groupBy(*keys).agg(*[F.approx_count_distinct(c, error).alias(n) for n, c in columns.items()])
    out = None
    for name, col in columns.items():
        one = df.select(*keys, col).distinct().groupBy(*keys).agg(F.count(col).alias(name))
        out = one if out is None else join_groups(out, one, keys)
    return out


def hub_totals(a: DataFrame, a_key: str, b: DataFrame, b_key: str, name: str) -> DataFrame:
    """Departures and arrivals summed by airport; each side is counted before the union."""
    one = a.groupBy(F.col(a_key).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    two = b.groupBy(F.col(b_key).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(two).groupBy(name).agg(F.sum("n").alias("total"))


def rank_global_label(totals: DataFrame, key: str, total: str, upto: int = HUB_RANK) -> DataFrame:
    """``hub`` for keys ranked at most ``upto`` by total (ties share a rank), else ``non-hub``.

    The rank that splits the two is the total of the ``upto``-th row, so k rows
    meet in one task instead of all keys.
    """
    edge = totals.orderBy(F.desc(total)).limit(upto).agg(F.min(total).alias("edge")).scalar()
    return totals.withColumn("hub_status", F.when(F.col(total) >= edge, "hub").otherwise("non-hub"))


def surrogate_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Unique but not dense; no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def dense_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id", parts: int | None = None) -> DataFrame:
    """Dense 1..n along a unique ``order`` without moving all rows to one task.

    Range partitioning on the whole order splits any hot value.  The sorted rows
    are written once, so counting and numbering see the same partitions; the
    offsets are one row per partition.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # partition number in the upper bits, position inside the partition in the lower 33
    tagged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tagged = cut_lineage(tagged.withColumn("_id", F.monotonically_increasing_id()))
    placed = tagged.withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered_rows = placed.join(F.broadcast(offsets), "_part")
    position = F.col("_id") - F.shiftleft("_part", 33)
    return numbered_rows.select(*df.columns, (F.col("_before") + position + 1).alias(name))


def top_k_per_group(df: DataFrame, keys: Sequence[str], entity: str, score: str, k: int) -> DataFrame:
    """k best distinct entities per group: best row per entity, then a limit pushed below the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, entity, score)]
    best = df.groupBy(*keys, entity).agg(F.max(F.struct(score, *rest)).alias("_b"))
    flat = best.select(*keys, entity, "_b.*")
    w = W.partitionBy(*keys).orderBy(F.desc(score), entity)
    return flat.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def cap_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, block: Column | None = None
) -> DataFrame:
    """At most n rows per class in order; the cap itself is the feature.

    For small n Spark keeps n rows per class and task before the shuffle.  For a
    large n give a ``block`` that grows along the order (a day, say): blocks
    behind the first n rows are dropped by their counts before any row is sorted.
    """
    rows = df
    if block is not None:
        rows = df.withColumn("_block", block)
        sizes = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
        before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        early = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < n)
        rows = join_groups(rows, early.select(*keys, "_block"), [*keys, "_block"], "left_semi").drop("_block")
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_event(df: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """First row per entity where the condition holds, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.where(condition).groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*keys, "_f.*")
