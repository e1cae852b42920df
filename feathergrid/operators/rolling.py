"""Rolling sums over time ranges, safe for hot keys and long frames.

A sliding frame re-reads every row of the frame for every row, and keeps one
key in one task.  Rolling sums need neither.  The sum of a frame is the running
total at its end less the one before its start, and a running total over a range
of time is taken in one pass along the rows.  Time is cut into blocks at least as
long as a frame.  A row lies whole in its own block; only if it has something to
add, its second and measures are copied to the other blocks in whose frames it
counts, at most two for a frame.  So blocks need nothing from each other, a hot
key runs in as many tasks as it has blocks, and there is one exchange per set of
keys and no join back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType

DAY = 86_400
HOUR = 3_600


def leaky_frame(span: int) -> tuple[int, int]:
    """Frame that ends at the current second and so contains the row's own label."""
    return (-span, 0)


def safe_frame(span: int, lead: int = 2 * HOUR) -> tuple[int, int]:
    """Frame that ends before the prediction time, ``lead`` seconds ahead of the row."""
    return (-(span + lead), -lead - 1)


#: Bits of the two limbs that hold a fraction; sums of 2**35 rows fit a whole number.
LIMBS = (26, 27)


def _limbs(df: DataFrame, measure: Column) -> list[Column]:
    """A measure as columns whose sums are exact: itself if a whole number or decimal, else whole part and two limbs."""
    kind = df.select(measure.alias("m")).schema["m"].dataType
    if isinstance(kind, DecimalType):
        return [measure]
    if not isinstance(kind, FractionalType):
        return [measure.cast("long")]
    value = measure.cast("double")
    upper = (value - F.floor(value)) * float(2 ** LIMBS[0])
    return [F.floor(value).cast("long"), F.floor(upper).cast("long"), F.floor((upper - F.floor(upper)) * float(2 ** LIMBS[1])).cast("long")]


def _joined(limbs: list[Column]) -> Column:
    if len(limbs) == 1:
        return limbs[0]
    whole, upper, lower = (c.cast("double") for c in limbs)
    return whole + (upper + lower / float(2 ** LIMBS[1])) / float(2 ** LIMBS[0])


def with_rolling(
    df: DataFrame,
    keys: Sequence[str],
    seconds: str,
    measures: Mapping[str, Column],
    frames: Mapping[str, tuple[int, int]],
    block_seconds: int = DAY,
) -> DataFrame:
    """``df`` with ``<measure>_<frame>`` sums: rows of the same keys whose second lies in the frame around the row's.

    Running totals of floating-point numbers would not come back to zero, so
    they are exact: whole numbers and decimals as such, other numbers as a whole
    part and 53 bits of fraction (what lies below 2**-53 is cut off; infinite
    values stop the query).  Null measures count as 0, null keys are a key, rows
    without a second get null.
    """
    width = max([block_seconds, *[end - start + 1 for start, end in frames.values()]])
    limbs = {m: _limbs(df, e) for m, e in measures.items()}
    values = {(m, i): F.coalesce(limb, F.lit(0)) for m, cols in limbs.items() for i, limb in enumerate(cols)}
    names, moved = [f"_k{i}" for i in range(len(keys))], [f"_v{n}" for n in range(len(values))]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    ready = df.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)],
        F.col(seconds).cast("long").alias("_at"),
        row.alias("_row"),
        *[v.alias(n) for n, v in zip(moved, values.values(), strict=True)],
    )

    def block_of(at: Column) -> Column:
        return F.floor(at / width)

    # rows without a second are spread; a value at second s counts for rows from s-end to s-start
    ready = ready.withColumn("_own", F.coalesce(block_of(F.col("_at")), F.xxhash64("_row")))
    reached = [block_of(F.col("_at") - edge) for edge in sorted({edge for frame in frames.values() for edge in frame})]
    adds = F.col("_at").isNotNull() & reduce(or_, [F.col(n) != 0 for n in moved], F.lit(False))
    own = F.array("_own")
    leaves = reduce(or_, [block != F.col("_own") for block in reached], F.lit(False))
    blocks = F.when(adds & leaves, F.concat(own, F.array_except(F.array(*reached), own))).otherwise(own)
    placed = ready.select(*names, "_at", "_row", *moved, F.posexplode(blocks).alias("_place", "_block"))
    placed = placed.withColumn("_row", F.when(F.col("_place") == 0, F.col("_row"))).drop("_place")
    # rows that lie together by key alone, after a join say, would keep a hot key in one task
    placed = placed.repartition(*names, "_block")
    # the block first: sorting compares the first column cheaply, and there can be few keys
    along = W.partitionBy("_block", *names).orderBy("_at")
    # running totals up to a frame's end, and up to the second before its start; frames share those at the same second
    edges = sorted({edge for start, end in frames.values() for edge in (start - 1, end)})
    totals = placed.select(
        "_row",
        *[
            F.sum(name).over(along.rangeBetween(W.unboundedPreceding, edge)).alias(f"_s{n}_{e}")
            for n, name in enumerate(moved)
            for e, edge in enumerate(edges)
        ],
    )
    kinds = totals.schema

    def total(n: int, edge: int) -> Column:
        return F.coalesce(F.col(f"_s{n}_{edges.index(edge)}"), F.lit(0))

    def inside(n: int, frame: str) -> Column:
        start, end = frames[frame]
        return (total(n, end) - total(n, start - 1)).cast(kinds[f"_s{n}_0"].dataType)

    number = {key: n for n, key in enumerate(values)}
    sums = [
        F.when(F.col(f"_row.`{seconds}`").isNotNull(), _joined([inside(number[m, i], f) for i in range(len(cols))])).alias(f"{m}_{f}")
        for m, cols in limbs.items()
        for f in frames
    ]
    return totals.where("_row is not null").select("_row.*", *sums)


def rolling_mean_of_flag(df: DataFrame, keys: Sequence[str], seconds: str, flag: Column, span: int, name: str) -> DataFrame:
    """Mean of a 0/1 flag over the last ``span`` seconds; null flags do not count."""
    measures = {"hits": flag, "seen": F.when(flag.isNotNull(), 1).otherwise(0)}
    out = with_rolling(df, keys, seconds, measures, {"w": leaky_frame(span)})
    return out.withColumn(name, F.try_divide("hits_w", "seen_w")).drop("hits_w", "seen_w")
