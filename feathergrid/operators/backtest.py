"""Top-k portfolio back-test: labels, picks, holding returns, benchmark and summary tables.

Prices hold one row per ticker and day.  A cohort bought in one month is held
for ``hold`` months, so a price row belongs to at most ``hold`` cohorts; holding
windows are whole months and become an equi join on (ticker, month).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feathergrid.functions.columns import daily_rate
from feathergrid.operators.joins import calendar_asof_fill, left_benchmark
from feathergrid.operators.rows import top_k_per_group
from feathergrid.operators.series import along, cumulative_return, lead_forward_return, pct_change

# fixed values: stocks per cohort, months held, stake per cohort
PICKS, HOLD_MONTHS, STAKE = 5, 12, 100.0


def outperform_label(
    prices: DataFrame, benchmark: DataFrame, day: str, price: str, entity: str, rows: int = 250, keep: Sequence[str] = ()
) -> DataFrame:
    """1 where the entity's one-year return beats the benchmark's; unknown counts as 0.  Columns to ``keep`` go along."""
    own = lead_forward_return(prices, [entity], day, price, rows).select(entity, day, *keep, "forward_return")
    series = benchmark.select(F.lit(0).alias("_one"), day, price)
    bench = lead_forward_return(series, ["_one"], day, price, rows)
    bench = bench.select(day, F.col("forward_return").alias("benchmark_return"))
    joined = left_benchmark(own, bench, day)
    better = F.col("forward_return") > F.col("benchmark_return")
    return joined.withColumn("outperformed", F.when(better, 1).otherwise(0))


def holding_months(cohorts: DataFrame, start: str, hold: int = HOLD_MONTHS) -> DataFrame:
    last = F.add_months(start, hold - 1)
    return cohorts.withColumn("_month", F.explode(F.sequence(F.col(start), last, F.expr("interval 1 month"))))


def pick_top_k(scores: DataFrame, prices: DataFrame, k: int = PICKS, hold: int = HOLD_MONTHS) -> DataFrame:
    """``scores(month, ticker, probability)`` to ``(start_date, ticker, probability, pick)``.

    A cohort starts the month after its score; a ticker needs a price while held.
    Each ticker has one row with the months it has prices in (the calendar bounds
    it), so a score meets one row and no score is copied per month.
    """
    month = (F.year("datadate") * 12 + F.month("datadate")).alias("m")
    months = prices.select(F.col("tic").alias("ticker"), month).distinct()
    present = months.groupBy("ticker").agg(F.collect_list("m").alias("_months"))
    start = F.add_months(F.col("month"), 1)
    dated = scores.withColumn("start_date", start).withColumn("_m", F.year(start) * 12 + F.month(start)).drop("month")
    held = F.exists("_months", lambda m: (m >= F.col("_m")) & (m < F.col("_m") + hold))
    known = dated.join(present, "ticker").where(held).drop("_months", "_m").distinct()
    return top_k_per_group(known, ["start_date"], "ticker", "probability", k)


def held_prices(picks: DataFrame, prices: DataFrame, hold: int = HOLD_MONTHS) -> DataFrame:
    monthly = prices.withColumn("_month", F.trunc("datadate", "month")).withColumnRenamed("tic", "ticker")
    return holding_months(picks, "start_date", hold).join(monthly, ["ticker", "_month"]).drop("_month")


def pick_returns(picks: DataFrame, prices: DataFrame, price: str = "price", hold: int = HOLD_MONTHS) -> DataFrame:
    """Per cohort and day: equal-weight mean of the picks' daily changes, and its cumulative return."""
    w = along(["start_date", "ticker"], ["datadate"])
    changes = held_prices(picks, prices, hold).withColumn("change", pct_change(price, w))
    daily = changes.groupBy("start_date", "datadate").agg(F.avg("change").alias("average"))
    return daily.withColumn("cumulative", cumulative_return("average", along(["start_date"], ["datadate"])))


def benchmark_returns(starts: DataFrame, benchmark: DataFrame, price: str = "price", hold: int = HOLD_MONTHS) -> DataFrame:
    """Daily change and cumulative return of the benchmark inside each cohort's window."""
    monthly = benchmark.withColumn("_month", F.trunc("datadate", "month"))
    held = holding_months(starts, "start_date", hold).join(monthly, "_month").drop("_month")
    w = along(["start_date"], ["datadate"])
    changed = held.withColumn("average", pct_change(price, w)).select("start_date", "datadate", "average")
    return changed.withColumn("cumulative", cumulative_return("average", w))


def cohort_finals(returns: DataFrame, name: str) -> DataFrame:
    return returns.groupBy("start_date").agg(F.max_by("cumulative", "datadate").alias(name))


def cohort_summary(own: DataFrame, bench: DataFrame, stake: float = STAKE) -> DataFrame:
    """One row: share of cohorts ahead, capital at risk, total and annualised return of both sides.

    ``annual_of_gains`` takes the sum of gains over the sum invested, as
    published; ``annual_of_value`` takes principal plus gains.
    """
    both = cohort_finals(own, "own").join(cohort_finals(bench, "bench"), "start_date")
    loss = [F.sum(F.when(F.col(c) < 0, -F.col(c) * stake).otherwise(0.0)) for c in ("own", "bench")]
    total = both.agg(
        F.count(F.lit(1)).alias("cohorts"),
        F.avg(F.when(F.col("own") > F.col("bench"), 1.0).otherwise(0.0)).alias("outperform"),
        loss[0].alias("risk"),
        loss[1].alias("benchmark_risk"),
        (F.sum("own") * stake).alias("total"),
        (F.sum("bench") * stake).alias("benchmark_total"),
    )
    invested = F.col("cohorts") * stake
    power = F.lit(12.0) / F.col("cohorts")

    def annual(amount):
        return F.when(amount > 0, F.pow(amount / invested, power) - 1)

    return total.select(
        "*",
        annual(F.col("total")).alias("annual_of_gains"),
        annual(F.col("benchmark_total")).alias("benchmark_annual_of_gains"),
        annual(invested + F.col("total")).alias("annual_of_value"),
    )


def sharpe(daily: DataFrame, rates: DataFrame, calendar: DataFrame, bond: str, rate: str) -> DataFrame:
    """mean / stddev of daily return over the daily risk-free rate, per bond series.

    ``daily(datadate, average)``; ``rates`` is a monthly series in percent,
    carried forward over the trading calendar.
    """
    filled = calendar_asof_fill(calendar, rates, [bond], "datadate", rate)
    free = filled.select(bond, "datadate", daily_rate(F.col(rate)).alias("_free"))
    excess = left_benchmark(free, daily, "datadate").withColumn("_x", F.col("average") - F.col("_free"))
    return excess.groupBy(bond).agg(
        F.count("_x").alias("days"), F.try_divide(F.avg("_x"), F.stddev_samp("_x")).alias("sharpe")
    )


def calendar_year_slices(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per calendar year: days, mean daily average and the last cumulative value."""
    return returns.groupBy(*keys, F.year("datadate").alias("yr")).agg(
        F.count(F.lit(1)).alias("days"), F.avg("average").alias("mean_average"), F.avg("cumulative").alias("mean_cumulative")
    )


def trading_days(prices: DataFrame, day: str = "datadate") -> DataFrame:
    """The calendar is the set of days with any price."""
    return prices.select(day).distinct()
