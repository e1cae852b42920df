"""Joins the workloads need beyond a plain equi join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feathergrid.functions.geo import haversine_km
from feathergrid.session import cut_lineage


def left_multi_key(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Left join; columns both sides carry come back from the right side under ``suffix``."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), list(on), "left")


def left_benchmark(left: DataFrame, benchmark: DataFrame, on: str) -> DataFrame:
    """Join one row per date to every entity; Spark broadcasts the series while its size allows."""
    return left.join(benchmark, on, "left")


def lookup(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Map a key through a dictionary table.

    No hint: below ``spark.sql.autoBroadcastJoinThreshold`` (file size, or the
    size measured at run time) Spark broadcasts, above it the join is shuffled
    and a skewed side is split.
    """
    return df.join(dim, on, "left")


def interval_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str, lo: int, hi: int
) -> DataFrame:
    """Pairs with equal keys and ``lo <= left_t - right_t <= hi`` (seconds).

    Time is cut into buckets as wide as the window, so a left row meets at most
    two buckets and a hot key is spread along time.
    """
    width = max(hi - lo, 1)
    first = F.floor((F.col(left_t) - hi) / width)
    last = F.floor((F.col(left_t) - lo) / width)
    probes = left.withColumn("_bucket", F.explode(F.sequence(first, last)))
    build = right.withColumn("_bucket", F.floor(F.col(right_t) / width))
    lag = F.col(left_t) - F.col(right_t)
    joined = probes.join(build, [*keys, "_bucket"], "inner")
    return joined.where(lag.between(lo, hi)).drop("_bucket")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    right_order: str,
    lo: int,
    hi: int,
) -> DataFrame:
    """Each left row with the latest right row whose lag lies in ``[lo, hi]``, as struct ``match``.

    A null key matches nothing: such left rows stay without a match.  Right rows
    are shifted by ``lo``, copied into the one or two time blocks in
    which they can still match, and carried forward by a running maximum: one
    shuffle, no pairs, and blocks no wider than the window.  Right rows with the
    same second are resolved by ``right_order``, so a left row matches once.
    """
    width = max(hi - lo, 1)
    right = right.na.drop(subset=list(keys))
    payload = F.struct(F.col(right_t).alias("t"), F.col(right_order).alias("id"), F.struct("*").alias("row"))
    best = right.select(*keys, payload.alias("_p")).groupBy(*keys, F.col("_p.t").alias("_s"))
    reports = best.agg(F.max_by("_p", "_p.id").alias("_p"))
    first = F.floor((F.col("_s") + lo) / width)
    last = F.floor((F.col("_s") + hi) / width)
    empty = F.lit(None)
    left_rows = left.select(
        *keys,
        F.floor(F.col(left_t) / width).alias("_block"),
        F.col(left_t).alias("_at"),
        F.lit(1).alias("_side"),
        F.struct("*").alias("_left"),
        empty.cast(reports.schema["_p"].dataType).alias("_p"),
    )
    right_rows = reports.select(
        *keys,
        F.explode(F.sequence(first, last)).alias("_block"),
        (F.col("_s") + lo).alias("_at"),
        F.lit(0).alias("_side"),
        empty.cast(left_rows.schema["_left"].dataType).alias("_left"),
        "_p",
    )
    # the copied report starts at its true time, so the running value is the latest one
    along = W.partitionBy(*keys, "_block").orderBy("_at", "_side")
    along = along.rowsBetween(W.unboundedPreceding, 0)
    carried = left_rows.unionByName(right_rows).withColumn("_m", F.last("_p", ignorenulls=True).over(along))
    lag = F.col(f"_left.{left_t}") - F.col("_m.t")
    return (
        carried.where(F.col("_side") == 1)
        .withColumn("_m", F.when(lag.between(lo, hi), F.col("_m")))
        .select("_left.*", F.col("_m.row").alias("match"))
    )


def asof_join_all_ties(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    right_order: str,
    lo: int,
    hi: int,
) -> DataFrame:
    """As-of join that returns every right row of the matched second, as joining back on the lag does."""
    once = asof_join(left, right, keys, left_t, right_t, right_order, lo, hi)
    matched = once.where(F.col("match").isNotNull()).withColumn("_s", F.col(f"match.{right_t}")).drop("match")
    reports = right.select(*keys, F.col(right_t).alias("_s"), F.struct("*").alias("match"))
    return matched.join(reports, [*keys, "_s"], "inner").drop("_s")


# Points of a cube that is cut no further.
LEAF_POINTS = 32
# The children of a cube: its edge in quarters.
_CUT = 4


def _on_sphere(df: DataFrame, lat: str, lon: str, *more: str) -> DataFrame:
    phi, lam = F.radians(lat), F.radians(lon)
    x, y, z = F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)
    return df.select(lat, lon, *more, x.alias("x"), y.alias("y"), z.alias("z"))


def _cubes(level: int) -> list[Column]:
    """The cube of a point at a level: level 0 has edge 2, each further one a quarter of it."""
    return [F.floor((F.col(a) + 1.0) / (2.0 / _CUT**level)).cast("long").alias(f"c{a}") for a in "xyz"]


def _chord(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}{x}") - F.col(f"{b}{x}")) ** 2 for x in "xyz"), F.lit(0.0)))


_CUBE = ["cx", "cy", "cz"]


class _CubeTree:
    """Points of the sphere in cubes that are cut as long as they hold more than ``leaf`` points.

    ``levels[l]`` has one row per cube of level ``l`` whose parent was cut: its
    coordinates, one point of it (``px, py, pz``) and whether it is a leaf;
    ``leaves[l]`` has the points of its leaves.  The depth comes from the data:
    only crowded cubes go on, and points differ, so every cube ends as a leaf.
    """

    def __init__(self, points: DataFrame, leaf: int):
        self.levels, self.leaves = [], []
        left, level = cut_lineage(points), 0
        while True:
            placed = left.select("*", *_cubes(level))
            cubes = placed.groupBy(*_CUBE).agg(
                F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y", "z")).alias("_p")
            )
            cubes = cut_lineage(cubes.select(*_CUBE, "n", *[F.col(f"_p.{a}").alias(f"p{a}") for a in "xyz"], (F.col("n") <= leaf).alias("leaf")))
            marked = placed.join(cubes.select(*_CUBE, "leaf"), _CUBE)
            self.levels.append(cubes.drop("n"))
            self.leaves.append(cut_lineage(marked.where("leaf").drop("leaf")))
            if not cubes.where("not leaf").limit(1).count():
                return
            left, level = cut_lineage(marked.where("not leaf").select(points.columns)), level + 1


def nearest_point(
    left: DataFrame, left_id: str, right: DataFrame, right_id: str, lat: str = "lat", lon: str = "lon", leaf: int = LEAF_POINTS
) -> DataFrame:
    """Nearest right point on the sphere for each left point, without comparing all pairs.

    Right points lie in a tree of cubes.  Level by level a left point keeps the
    cubes that may hold a nearer point than the nearest of the cubes' sample
    points; their children are next.  The distance to a sample point is at most a
    diagonal more than to its cube, so a left point keeps a few cubes at any level
    and is compared with the points of a few leaves, however dense the place.
    Ties go to the smallest right id.  Equal coordinates are compared once.
    """
    # a point without coordinates is near to none
    known = (F.col(lat).isNotNull()) & (F.col(lon).isNotNull())
    places = right.where(known).groupBy(lat, lon).agg(F.min(right_id).alias("_rid"))
    tree = _CubeTree(_on_sphere(places, lat, lon, "_rid"), leaf)
    points = _on_sphere(left.where(known).select(lat, lon).distinct(), lat, lon)
    front = points.withColumns({f"q{a}": F.lit(0).cast("long") for a in "xyz"}).withColumn("_bound", F.lit(4.0))
    found = None
    for level, cubes in enumerate(tree.levels):
        edge = 2.0 / _CUT**level
        if level == 0:
            first = cubes.collect()  # at most 8 cubes of edge 2
            if not first:
                return left.select(left_id, lat, lon).select(
                    left_id, F.lit(None).cast(right.schema[right_id].dataType).alias(right_id), F.lit(None).cast("double").alias("distance_km")
                )
            listed = [F.struct(*[F.lit(v).alias(c) for c, v in r.asDict().items()]) for r in first]
            met = front.select("*", F.inline(F.array(*listed)))
        else:
            children = cubes.withColumns({f"q{a}": F.floor(F.col(f"c{a}") / _CUT) for a in "xyz"})
            met = front.join(children, ["qx", "qy", "qz"])
        # distance to the cube itself, from its corner nearest to the point
        gaps = [F.greatest(F.lit(0.0), F.col(f"c{a}") * edge - 1.0 - F.col(a), F.col(a) - ((F.col(f"c{a}") + 1) * edge - 1.0)) for a in "xyz"]
        low = F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))
        sample = F.least("_bound", F.min(_chord("", "p")).over(W.partitionBy(lat, lon)))
        near = met.withColumn("_bound", sample).where(low <= F.col("_bound") * (1 + 1e-9) + 1e-12)
        near = cut_lineage(near.select(lat, lon, "x", "y", "z", "_bound", *_CUBE, "leaf"))
        there = tree.leaves[level].select(*_CUBE, F.col(lat).alias("_rlat"), F.col(lon).alias("_rlon"), "_rid")
        hits = near.where("leaf").join(there, _CUBE)
        km = haversine_km(F.col(lat), F.col(lon), F.col("_rlat"), F.col("_rlon"))
        best = hits.groupBy(lat, lon).agg(F.min(F.struct(km.alias("km"), F.col("_rid").alias("id"))).alias("_b"))
        found = best if found is None else found.unionByName(best)
        front = near.where("not leaf").select(lat, lon, "x", "y", "z", "_bound", *[F.col(f"c{a}").alias(f"q{a}") for a in "xyz"])
    picked = found.groupBy(lat, lon).agg(F.min("_b").alias("_b"))
    picked = picked.select(lat, lon, F.col("_b.id").alias(right_id), F.col("_b.km").alias("distance_km"))
    return left.select(left_id, lat, lon).join(picked, [lat, lon], "left").select(left_id, right_id, "distance_km")


def align_full_outer(series: Mapping[str, DataFrame], on: str, value: str) -> DataFrame:
    """Several (date, value) series side by side: one union and one aggregate, not a join chain."""
    tagged = None
    for name, df in series.items():
        one = df.select(on, F.lit(name).alias("_series"), F.col(value).alias("_value"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(on).agg(
        *[F.max(F.when(F.col("_series") == n, F.col("_value"))).alias(n) for n in series]
    )


def ratio_of_two_aggs(df: DataFrame, keys: Sequence[str], part: Column, whole: Column, name: str) -> DataFrame:
    """Numerator and denominator by group in one pass, matched by key and not by position."""
    return df.groupBy(*keys).agg(F.sum(part).alias("numerator"), F.sum(whole).alias("denominator")).withColumn(
        name, F.try_divide("numerator", "denominator")
    )


def calendar_asof_fill(calendar: DataFrame, series: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Reindex a sparse series on the calendar days and carry the last value forward.

    Each key only gets the days from its first point on; a key holds at most one
    row per calendar day plus its own points, so the window stays bounded.
    """
    span = series.groupBy(*keys).agg(F.min(day).alias("_first"))
    last_day = calendar.agg(F.max(day).alias("d"))
    days = span.select(
        *keys, F.explode(F.sequence(F.col("_first"), last_day.scalar(), F.expr("interval 1 day"))).alias(day)
    )
    trading = days.join(calendar.select(day).distinct(), day, "left_semi").withColumn("_open", F.lit(1))
    points = series.select(*keys, day, value)
    merged = trading.join(points, [*keys, day], "full_outer")
    along = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    filled = merged.withColumn(value, F.last(value, ignorenulls=True).over(along))
    return filled.where(F.col("_open") == 1).select(*keys, day, value)
