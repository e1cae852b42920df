"""Running totals, row numbers, ranks and percentiles over groups of any size.

A plain window keeps a whole group in one task.  Here a group is cut into
*blocks* along its order: each block is summed on its own, the block totals are
accumulated (one row per block), and rows add their block's offset to a local
running total.  The result equals the plain window; a hot group spreads over
as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group keys where null is a group like any other, as in ``groupBy`` and windows.

    Returns the columns of ``left`` and, unless ``how`` is a semi join, the rest of ``right``.
    """
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = left.alias("l").join(right.alias("r"), condition, how)
    if how == "left_semi":
        return joined
    return joined.select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def cut_points(df: DataFrame, col: str, parts: int | None = None) -> list[float]:
    """Approximate quantiles that cut a column into as many ranges as there are shuffle partitions.

    They balance the blocks and never change results.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / parts for i in range(1, parts)]
    if not probs:
        return []
    quantiles = F.percentile_approx(F.col(col).cast("double"), probs, max(1000, 4 * parts))
    row = df.agg(quantiles.alias("q")).first()
    return sorted({float(v) for v in (row["q"] or [])})


def _cut(df: DataFrame, col: str, cuts: Sequence[float], name: str) -> DataFrame:
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    tmp = f"{name}_v"
    bucketizer = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol=tmp, outputCol=name, handleInvalid="keep"
    )
    return bucketizer.transform(df.withColumn(tmp, F.col(col).cast("double"))).drop(tmp)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: str,
    measures: Mapping[str, Column],
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums of ``measures`` along ``order`` inside ``keys``.

    ``block`` must not decrease along ``order`` and ``order`` must be unique
    inside a key, so that "rows up to here" has one meaning.
    """
    work = df.select("*", *[m.alias(f"_m_{n}") for n, m in measures.items()])
    totals = work.groupBy(*keys, block).agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in measures])
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, block, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in measures]
    )
    local = W.partitionBy(*keys, block).orderBy(*order)
    local = local.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    joined = join_groups(work, offsets, [*keys, block])
    out = [
        (F.col(f"_o_{n}") + F.coalesce(F.sum(f"_m_{n}").over(local), F.lit(0))).alias(n) for n in measures
    ]
    return joined.select(*df.columns, *out)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], block: str, name: str = "row_number"
) -> DataFrame:
    """Exact ``row_number`` inside ``keys`` without one task per key."""
    return running_totals(df, keys, order, block, {name: F.lit(1).cast("long")})


def value_counts_running(
    df: DataFrame, keys: Sequence[str], col: str, parts: int | None = None, measures: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per (keys, value): its count ``n``, and ``upto`` = rows with a value <= it.

    Further ``measures`` are summed per value and accumulated as ``upto_<name>``.
    """
    extra = measures or {}
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(*keys, col)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(n) for n, m in extra.items()])
    )
    blocked = _cut(counts, col, cut_points(df, col, parts), "_block")
    return running_totals(
        blocked, keys, [col], "_block", {"upto": F.col("n"), **{f"upto_{n}": F.col(n) for n in extra}}
    ).drop("_block")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], col: str, probs: Mapping[str, float], parts: int | None = None
) -> DataFrame:
    """Linear-interpolated percentiles per key from running value counts.

    ``percentile`` buffers every distinct value of a group in one task; this
    reads the two neighbouring order statistics out of distributed counts.
    """
    running = value_counts_running(df, keys, col, parts)
    size = df.groupBy(*keys).agg(F.count(col).alias("_total"))
    if keys:
        joined = join_groups(running, size, keys)
    else:
        joined = running.withColumn("_total", size.select("_total").scalar())
    below = F.col("upto") - F.col("n")
    stats = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (below <= rank) & (rank < F.col("upto"))
            stats.append(F.max(F.when(hit, F.col(col).cast("double"))).alias(f"_{tag}_{name}"))
    picked = joined.groupBy(*keys).agg(F.max("_total").alias("_total"), *stats)
    out = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out)
