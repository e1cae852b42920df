"""Aggregates, profiles, tables of counts and statistics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feathergrid.operators.blocks import array_sums
from feathergrid.operators.ordered import exact_percentiles, join_groups, value_counts_running

# the quantiles a column summary reports
SUMMARY_QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def with_totals(df: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Add whole-table aggregates to every row from one aggregate row (an uncorrelated subquery)."""
    one = df.agg(F.struct(*[c.alias(n) for n, c in totals.items()]).alias("t")).scalar()
    return df.withColumn("_totals", one).select("*", *[F.col(f"_totals.{n}").alias(n) for n in totals]).drop("_totals")


def group_count_sorted(df: DataFrame, keys: Sequence[str], more_than: int = 0) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > more_than).orderBy(F.desc("n"), *keys)


def pct_frequency(df: DataFrame, col: str) -> DataFrame:
    """Value, non-null count and percentage of all rows, rounded half to even."""
    counts = df.groupBy(col).agg(F.count(col).alias("n"), F.count(F.lit(1)).alias("_rows"))
    shares = with_totals(counts, {"_all": F.sum("_rows")})
    return shares.select(col, "n", F.bround(F.col("n") * 100 / F.col("_all"), 2).alias("percentage"))


def cell_counts(df: DataFrame, row: str, col: str) -> DataFrame:
    """The contingency table as ``(row, col, n)``, whatever values there are, null included."""
    return df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Contingency table with a column per listed value and ``other`` for all else; a missing cell is 0."""
    cells = cell_counts(df, row, col)
    listed = [F.coalesce(F.sum(F.when(F.col(col) == v, F.col("n"))), F.lit(0)).alias(str(v)) for v in values]
    rest = F.when(F.coalesce(F.col(col).isin(list(values)), F.lit(False)), 0).otherwise(F.col("n"))
    return cells.groupBy(row).agg(*listed, F.sum(rest).alias("other"))


def summary_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, stddev, min, five percentiles, max.

    All columns go through the same aggregates as rows ``(column, value)``, so
    the number of scans and shuffles does not depend on how many there are.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    moments = group_moments_of(long, ["column"], "value")
    quant = exact_percentiles(long, ["column"], "value", SUMMARY_QUANTILES)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    found = names.join(moments, "column", "left").join(quant, "column", "left")
    return found.withColumn("n", F.coalesce("n", F.lit(0)))


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: nulls and their share, from one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = wide.unpivot(["_n"], list(df.columns), "column", "nulls")
    return long.select("column", "nulls", F.try_divide("nulls", "_n").alias("share"))


def blank_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c) == "").alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "blanks")


def conditional_rate(df: DataFrame, keys: Sequence[str], flag: Column, more_than: int = 0) -> DataFrame:
    """Share of flag = 1 among rows whose flag is known, in one pass."""
    rates = df.groupBy(*keys).agg(F.count(flag).alias("n"), F.avg(flag).alias("rate"))
    return rates.where(F.col("n") > more_than)


def group_moments_of(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Count, mean, stddev, min and max by group."""
    return df.groupBy(*keys).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("stddev"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )


def group_moments(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Count, mean, stddev, min, max and exact median by group."""
    moments = group_moments_of(df, keys, col)
    return join_groups(moments, exact_percentiles(df, keys, col, {"median": 0.5}), keys, "left")


def corr_pairs(df: DataFrame, cols: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """Long Pearson matrix ``(f1, f2, r)`` of all column pairs; nulls become ``fill``.

    One pass for the means, one for the cross products of the centred columns as
    matrix products of blocks of rows, whatever the number of columns.  Without
    ``fill`` a pair counts the rows that have both.  A column without variance has
    no correlation (null).  The driver holds a few numbers per pair.
    """
    k = len(cols)
    data = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    data = data.na.fill(fill) if fill is not None else data
    found = data.agg(*[F.avg(F.nanvl(f"c{i}", F.lit(None).cast("double"))) for i in range(k)]).first() or []
    means = np.array([m or 0.0 for m in found])

    def make():
        total = np.zeros((k, 4 * k))

        def add(batch: pa.RecordBatch | None):
            if batch is None:
                return dict(enumerate(total))
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - means
            has = ~np.isnan(x)
            x, has = np.where(has, x, 0.0), has.astype(np.float64)
            total[:] += np.hstack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])

        return add

    rows = array_sums(data, make)
    n, sums, squares, products = np.hsplit(np.stack([rows.get(i, np.zeros(4 * k)) for i in range(k)]), 4)
    seen = np.maximum(n, 1)
    spread = squares - sums * sums / seen
    both = spread * spread.T
    r = np.divide(products - sums * sums.T / seen, np.sqrt(both), out=np.full((k, k), np.nan), where=both > 0)
    listed = [(a, b, float(r[i, j]) if r[i, j] == r[i, j] else None) for (i, a), (j, b) in combinations(enumerate(cols), 2)]
    return df.sparkSession.createDataFrame(listed, "f1 string, f2 string, r double")


def high_corr_pairs(pairs: DataFrame, above: float = 0.7) -> DataFrame:
    return pairs.where(F.abs("r") > above).orderBy(F.desc("r"))


def correlation_partners(pairs: DataFrame, strong: float = 0.9, negative: float = -0.7) -> DataFrame:
    """Per feature: partners with r >= ``strong``, for features without a strong negative partner."""
    both = pairs.select(F.col("f1").alias("feature"), "r").unionByName(pairs.select(F.col("f2").alias("feature"), "r"))
    counts = both.groupBy("feature").agg(
        F.count_if(F.col("r") >= strong).alias("partners"), F.count_if(F.col("r") < negative).alias("_opposed")
    )
    return counts.where((F.col("partners") > 0) & (F.col("_opposed") == 0)).drop("_opposed")


def corr_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r, its t statistic on n - 2 degrees of freedom, and the two-sided p-value."""
    one = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r")
    )
    one = one.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    p = F.udf(lambda t, n: None if t is None or n is None or n < 3 else student_tails(t, n - 2), "double")  # of one row
    return one.withColumn("p", p("t", "n"))


def student_tails(t: float, df: float) -> float:
    """Both tails of Student's distribution: the incomplete beta function by its continued fraction."""
    if math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= (a + 1) / (a + b + 2):
        return 1.0 - _beta_fraction(1 - x, b, a)
    return _beta_fraction(x, a, b)


def _beta_fraction(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value, m = d, 1
    while True:
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + numerator * d
            c = 1 + numerator / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15 or m > 1_000_000:
            return front * value
        m += 1


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed."""
    known = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias(col))
    ranged = with_totals(known, {"_lo": F.min(col), "_hi": F.max(col)})
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return ranged.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def empirical_cdf(df: DataFrame, col: str) -> DataFrame:
    """Share of rows <= each distinct value, without sorting the table into one task."""
    running = value_counts_running(df, [], col)
    return with_totals(running, {"_all": F.sum("n")}).select(col, (F.col("upto") / F.col("_all")).alias("cdf"))


def box_stats(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return exact_percentiles(df, keys, col, probs)


def utility_score(df: DataFrame, date: str, weight: str, resp: str, action: str) -> DataFrame:
    """Per-date profit p; t = sum p / sqrt(sum p^2) * sqrt(250 / dates); u = min(max(t, 0), 6) * sum p."""
    daily = df.groupBy(date).agg(F.sum(F.col(weight) * F.col(resp) * F.col(action)).alias("p"))
    total = daily.agg(F.sum("p").alias("sp"), F.sum(F.col("p") * F.col("p")).alias("spp"), F.count("p").alias("n"))
    t = F.when(F.col("spp") == 0, 0.0).otherwise(
        F.col("sp") / F.sqrt("spp") * F.sqrt(F.lit(250.0) / F.col("n"))
    )
    return total.withColumn("t", t).select(
        F.col("n").alias("dates"), "t", (F.least(F.greatest("t", F.lit(0.0)), F.lit(6.0)) * F.col("sp")).alias("utility")
    )


def zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    totals = {}
    for c in cols:
        totals[f"_mean_{c}"] = F.avg(c)
        totals[f"_sd_{c}"] = F.stddev_samp(c)
    wide = with_totals(df, totals)
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_mean_{c}"), F.col(f"_sd_{c}")) for c in cols}
    return wide.withColumns(scaled).select(*df.columns)


def minmax_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    totals = {}
    for c in cols:
        totals[f"_lo_{c}"] = F.min(c)
        totals[f"_hi_{c}"] = F.max(c)
    wide = with_totals(df, totals)
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in cols}
    return wide.withColumns(scaled).select(*df.columns)


def inf_replace(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Plus and minus infinity to the largest and smallest finite value of the column."""
    inf = float("inf")
    totals = {}
    for c in cols:
        finite = F.when(F.abs(c) != inf, F.col(c))
        totals[f"_lo_{c}"] = F.min(finite)
        totals[f"_hi_{c}"] = F.max(finite)
    wide = with_totals(df, totals)
    fixed = {
        c: F.when(F.col(c) == inf, F.col(f"_hi_{c}")).when(F.col(c) == -inf, F.col(f"_lo_{c}")).otherwise(F.col(c)) for c in cols
    }
    return wide.withColumns(fixed).select(*df.columns)
