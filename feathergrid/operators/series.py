"""Row-wise features of entity series.

A series has at most one row per entity and calendar day (aggregate it first),
so a window per entity is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feathergrid.functions.columns import clamped_ratio, clip

# fixed values: trading days per year, rows and days of the volatility window
TRADING_DAYS, VOLATILITY_ROWS, VOLATILITY_DAYS = 252, 21, 21
# fixed values: rows ahead for the one-year return
YEAR_ROWS = 250

# fixed values: lower bound, upper bound and mean fill of each ratio
RATIO_BOUNDS: dict[str, tuple[float | None, float | None, bool]] = {
    "sale_nwc": (-1000, 1000, False),
    "cash_conversion": (None, 2000, True),
    "inv_turn": (None, 200, False),
    "int_debt": (None, 5, True),
    "invt_act": (None, 1, True),
    "int_totdebt": (None, 5, True),
    "pretret_noa": (-4, 4, False),
    "pretret_earnat": (-2, 2, False),
    "rect_act": (None, 1, True),
    "ocf_lct": (-8, 8, False),
    "profit_lct": (-8, 8, False),
    "curr_debt": (None, 1, True),
    "quick_ratio": (None, 10, True),
    "efftax": (-1, 1, True),
    "intcov_ratio": (-500, 500, True),
    "dpr": (-4, 4, False),
    "fcf_ocf": (-10, 1, False),
    "peg_1yrforward": (None, None, True),
    "short_debt": (0, 1, False),
    "pay_turn": (-10, 100, False),
    "roe": (-5, 5, False),
    "sale_equity": (None, 30, True),
    "capei": (-100, 100, True),
    "dltt_be": (None, 10, False),
    "ptb": (None, 50, True),
    "rect_turn": (None, 200, True),
    "pe_op_basic": (-200, 200, True),
    "aftret_invcapx": (-1.5, 1.5, True),
    "lt_ppent": (None, 200, True),
    "pe_inc": (-100, 200, True),
    "cfm": (-5, 5, False),
    "debt_capital": (-5, 5, True),
    "cash_debt": (-5, 5, False),
    "roce": (-2, 2, False),
    "at_turn": (None, 2, False),
    "sale_invcap": (-1, 10, True),
    "adv_sale": (0, 1, True),
    "staff_sale": (None, 1, False),
    "gpm": (-5, 1, True),
    "evm": (-100, 100, True),
    "opmad": (-5, 1, True),
    "ps": (None, 100, True),
    "totdebt_invcap": (None, 5, False),
    "pcf": (-100, 100, True),
    "roa": (-1, 1, False),
    "accrual": (-1, 1, False),
    "aftret_equity": (-5, 5, False),
    "equity_invcap": (-1, 1, True),
    "capital_ratio": (-1, 2, False),
    "lt_debt": (None, 1, False),
    "gprof": (-1, 2, False),
    "cash_lt": (None, 10, False),
    "de_ratio": (-50, 50, False),
    "debt_assets": (None, 2, True),
    "rd_sale": (None, 5, False),
}


def along(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*order)


def lead_forward_return(df: DataFrame, keys: Sequence[str], day: str, value: str, rows: int = YEAR_ROWS) -> DataFrame:
    """Value and date ``rows`` ahead and the relative change; null at the end of a series."""
    w = along(keys, [day])
    ahead = df.withColumn("later_value", F.lead(value, rows).over(w)).withColumn("later_date", F.lead(day, rows).over(w))
    change = F.try_divide(F.col("later_value") - F.col(value), F.abs(value))
    return ahead.withColumn("forward_return", change)


def pct_change(value: str, w) -> Column:
    before = F.lag(value).over(w)
    return F.try_divide(F.col(value) - before, F.abs(before))


def lag_change_clamped(value: str, k: int, w, bound: float = 5.0) -> Column:
    """Change against k rows back over its absolute value, clamped; no earlier row gives 0."""
    before = F.lag(value, k).over(w)
    return F.when(before.isNotNull(), clamped_ratio(F.col(value) - before, F.abs(before), bound)).otherwise(F.lit(0.0))


def sma_rows(value: str, n: int, w) -> Column:
    """n-row moving average, null until n values are seen."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def rolling_stddev_days(value: str, day: str, keys: Sequence[str], days: int = VOLATILITY_DAYS) -> Column:
    """Sample stddev over calendar days; the frame reads at most ``days`` + 1 rows."""
    w = W.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(-days, 0)
    return F.stddev_samp(value).over(w)


def annualized_volatility(df: DataFrame, keys: Sequence[str], day: str, price: str, name: str = "volatility") -> DataFrame:
    """Stddev of 21 log returns times sqrt(252), at most 1; null until 21 returns are seen."""
    w = along(keys, [day])
    logs = df.withColumn("_r", F.log(F.try_divide(F.col(price), F.lag(price).over(w))))
    frame = w.rowsBetween(-(VOLATILITY_ROWS - 1), 0)
    full = F.count("_r").over(frame) == VOLATILITY_ROWS
    raw = F.when(full, F.stddev_samp("_r").over(frame) * F.sqrt(F.lit(float(TRADING_DAYS))))
    return logs.withColumn(name, clip(raw, upper=1.0)).drop("_r")


def forward_fill(value: str, w) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def backward_fill(value: str, w) -> Column:
    return F.first(value, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))


def fill_chain(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    bounds: Mapping[str, tuple[float | None, float | None, bool]] = RATIO_BOUNDS,
    fill_zero: bool = True,
) -> DataFrame:
    """Clip, fill forward, fill backward, entity mean, zero, for every bounded column at once.

    All columns share one partitioning and order, so this is one shuffle however many there are.
    """
    cols = [c for c in bounds if c in df.columns]
    w = along(keys, [day])
    whole = W.partitionBy(*keys)
    clipped = df.withColumns({c: clip(F.col(c), bounds[c][0], bounds[c][1]) for c in cols})
    forward = clipped.withColumns({c: forward_fill(c, w) for c in cols})
    both = forward.withColumns({c: backward_fill(c, w) for c in cols})
    means = {c: F.coalesce(c, F.avg(c).over(whole)) for c in cols if bounds[c][2]}
    filled = both.withColumns(means) if means else both
    if fill_zero:
        filled = filled.na.fill(0.0, subset=cols)
    return filled


def cumulative_return(change: str, w) -> Column:
    """Product of (1 + r) minus 1 along the order; a missing first change counts as 0.

    Growth of zero or below has no logarithm, so zeros and signs are counted beside it.
    """
    frame = w.rowsBetween(W.unboundedPreceding, 0)
    r = F.coalesce(F.col(change), F.lit(0.0))
    size = F.when(r > -1, F.log1p(r)).when(r < -1, F.log(-1 - r)).otherwise(F.lit(0.0))
    lost = F.sum(F.when(r == -1, 1).otherwise(0)).over(frame)
    flips = F.sum(F.when(r < -1, 1).otherwise(0)).over(frame)
    product = F.exp(F.sum(size).over(frame)) * (1 - 2 * (flips % 2))
    return F.when(lost > 0, F.lit(0.0)).otherwise(product) - 1


def last_day_in_period(df: DataFrame, keys: Sequence[str], day: str, period: str = "month") -> DataFrame:
    """1 on the last observed day of each (entity, period)."""
    w = W.partitionBy(*keys, F.trunc(F.col(day), period))
    return df.withColumn("is_last", F.when(F.col(day) == F.max(day).over(w), 1).otherwise(0))


def difference(value: str, lags: Sequence[int], keys: Sequence[str], order: Sequence[str], df: DataFrame, name: str) -> DataFrame:
    """Nested differences: ``lags=[12, 1]`` is the first difference of the seasonal one."""
    w = along(keys, order)
    out = df.withColumn(name, F.col(value))
    for k in lags:
        out = out.withColumn(name, F.col(name) - F.lag(name, k).over(w))
    return out


def acf(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int) -> DataFrame:
    """Autocorrelation ``(keys, lag, rho, n)`` at lags 1..lags."""
    w = along(keys, order)
    whole = W.partitionBy(*keys)
    centred = df.select(*keys, *order, (F.col(value) - F.avg(value).over(whole)).alias("_c"))
    lagged = centred.withColumns({f"_c{k}": F.lag("_c", k).over(w) for k in range(1, lags + 1)})
    sums = lagged.groupBy(*keys).agg(
        F.count("_c").alias("n"),
        F.sum(F.col("_c") * F.col("_c")).alias("_v"),
        *[F.sum(F.col("_c") * F.col(f"_c{k}")).alias(f"_s{k}") for k in range(1, lags + 1)],
    )
    rows = [
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_s{k}"), F.col("_v")).alias("rho")) for k in range(1, lags + 1)
    ]
    return sums.select(*keys, "n", F.inline(F.array(*rows)))


def durbin_watson(df: DataFrame, keys: Sequence[str], order: Sequence[str], residual: str) -> DataFrame:
    w = along(keys, order)
    step = F.col(residual) - F.lag(residual).over(w)
    stepped = df.withColumn("_d", step)
    return stepped.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("_d") * F.col("_d")), F.sum(F.col(residual) * F.col(residual))).alias("dw")
    )


