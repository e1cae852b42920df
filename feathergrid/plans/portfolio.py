"""Back-test queries on a deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from feathergrid.operators import backtest as B
from feathergrid.plans import roles
from feathergrid.plans.joining import _RATE_SQL, monthly_rates
from feathergrid.plans.registry import query
from feathergrid.session import cut_lineage, table

# a calm price, so that a year of daily changes stays readable
PX_SQL = f"select tic, datadate, round(100 + 50 * ratio, 6) as price from ({roles.PRICES_SQL})"
# the mean goes through a decimal sum, so that comparing returns does not depend on the order of rows
BX_SQL = f"""select datadate, cast(sum(cast(price as decimal(18, 6))) as double) / count(*) as price
    from ({PX_SQL}) group by 1"""
SCORE_SQL = """select date_trunc('month', l_shipdate)::date as month, l_suppkey as ticker,
    max(l_discount) * 9 + count(*) % 10 * 0.01 + l_suppkey % 7 * 0.0001 as probability from lineitem group by 1, 2"""
CTES = f"""
px as materialized ({PX_SQL}), bx as materialized ({BX_SQL}), score as materialized ({SCORE_SQL}),
cand as (select (month + interval 1 month)::date as start_date, ticker, probability from score s where exists (
    select 1 from px where tic = ticker and datadate >= (s.month + interval 1 month)::date
    and datadate < (s.month + interval 13 month)::date)),
picks as materialized (select * from (select *, row_number() over (partition by start_date order by probability desc, ticker)
    as pick from cand) where pick <= 5),
held as (select start_date, ticker, datadate, price, lag(price) over (partition by start_date, ticker order by datadate)
    as before from picks join px on tic = ticker and datadate >= start_date and datadate < (start_date + interval 1 year)::date),
daily as (select start_date, datadate, avg((price - before) / abs(before)) as average from held group by 1, 2),
own as materialized (select *, product(1 + coalesce(average, 0)) over (partition by start_date order by datadate rows
    unbounded preceding) - 1 as cumulative from daily),
starts as (select distinct start_date from picks),
bheld as (select start_date, datadate, price, lag(price) over (partition by start_date order by datadate) as before
    from starts join bx on datadate >= start_date and datadate < (start_date + interval 1 year)::date),
bdaily as (select start_date, datadate, (price - before) / abs(before) as average from bheld),
bench as materialized (select *, product(1 + coalesce(average, 0)) over (partition by start_date order by datadate rows
    unbounded preceding) - 1 as cumulative from bdaily)
"""


def px(spark, d, *also):
    return roles.prices(spark, d).select("tic", "datadate", F.round(100 + 50 * F.col("ratio"), 6).alias("price"), *also)


def mean_price(prices):
    """Daily mean over all tickers."""
    mean = F.sum(F.col("price").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))
    return prices.groupBy("datadate").agg(mean.alias("price"))


def bx(spark, d):
    return mean_price(px(spark, d))


def scores(spark, d):
    li = table(spark, d, "lineitem")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    best = F.max("l_discount") * 9 + F.count(F.lit(1)) % 10 * 0.01 + F.col("ticker") % 7 * 0.0001
    return li.groupBy(month.alias("month"), F.col("l_suppkey").alias("ticker")).agg(best.alias("probability"))


def picks(spark, d):
    return B.pick_top_k(scores(spark, d), px(spark, d))


def own(spark, d):
    return B.pick_returns(picks(spark, d), px(spark, d))


def bench(spark, d):
    starts = picks(spark, d).select("start_date").distinct()
    return B.benchmark_returns(starts, bx(spark, d))


@query(
    "b1o_outperform_label",
    f"""with px as ({PX_SQL}), bx as ({BX_SQL}),
        o as (select tic, datadate, (lead(price, 250) over (partition by tic order by datadate) - price) / abs(price) as r from px),
        b as (select datadate, (lead(price, 250) over (order by datadate) - price) / abs(price) as r from bx)
        select tic, cast(o.datadate as varchar) as datadate, case when o.r > b.r then 1 else 0 end as outperformed
        from o left join b on o.datadate = b.datadate""",
)
def b1(spark, d):
    out = B.outperform_label(px(spark, d), bx(spark, d), "datadate", "price", "tic")
    return out.select("tic", F.col("datadate").cast("string").alias("datadate"), "outperformed")


@query(
    "b2o_pick_top_k",
    f"with {CTES} select cast(start_date as varchar) as start_date, ticker, round(probability, 6) as probability, pick from picks",
)
def b2(spark, d):
    return picks(spark, d).select(
        F.col("start_date").cast("string").alias("start_date"),
        "ticker",
        F.round("probability", 6).alias("probability"),
        F.col("pick").cast("long").alias("pick"),
    )


# returns are fractions of prices in cents, so exact halves occur; this moves them off the edge in both engines
_OFF = 3e-12


def _shape(df):
    return df.select(
        F.col("start_date").cast("string").alias("start_date"),
        F.col("datadate").cast("string").alias("datadate"),
        (F.round(F.col("average") + _OFF, 7) + 0.0).alias("average"),
        (F.round(F.col("cumulative") + _OFF, 7) + 0.0).alias("cumulative"),
    )


_SHAPE = f"""select cast(start_date as varchar) as start_date, cast(datadate as varchar) as datadate,
    round(average + {_OFF!r}, 7) + 0.0 as average, round(cumulative + {_OFF!r}, 7) + 0.0 as cumulative"""


@query("b3o_pick_returns", f"with {CTES} {_SHAPE} from own")
def b3(spark, d):
    return _shape(own(spark, d))


@query("b4o_benchmark_returns", f"with {CTES} {_SHAPE} from bench")
def b4(spark, d):
    return _shape(bench(spark, d))


@query(
    "b5o_cohort_summary",
    f"""with {CTES},
    f as (select o.start_date, o.r as own, b.r as bench from
      (select start_date, max_by(cumulative, datadate) as r from own group by 1) o join
      (select start_date, max_by(cumulative, datadate) as r from bench group by 1) b using (start_date)),
    s as (select count(*) as cohorts, avg(case when own > bench then 1.0 else 0.0 end) as outperform,
      sum(case when own < 0 then -own * 100 else 0 end) as risk, sum(case when bench < 0 then -bench * 100 else 0 end)
      as benchmark_risk, sum(own) * 100 as total, sum(bench) * 100 as benchmark_total from f)
    select cohorts, round(outperform, 6) as outperform, round(risk, 6) as risk, round(benchmark_risk, 6) as benchmark_risk,
      round(total, 6) as total, round(benchmark_total, 6) as benchmark_total,
      case when total > 0 then round(pow(total / (cohorts * 100), 12.0 / cohorts) - 1, 8) end as annual_of_gains,
      case when benchmark_total > 0 then round(pow(benchmark_total / (cohorts * 100), 12.0 / cohorts) - 1, 8) end
        as benchmark_annual_of_gains,
      case when cohorts * 100 + total > 0 then round(pow((cohorts * 100 + total) / (cohorts * 100), 12.0 / cohorts) - 1, 8) end
        as annual_of_value from s""",
)
def b5(spark, d):
    chosen = cut_lineage(picks(spark, d))  # both sides start from the same picks
    starts = chosen.select("start_date").distinct()
    out = B.cohort_summary(B.pick_returns(chosen, px(spark, d)), B.benchmark_returns(starts, bx(spark, d)))
    six = ["outperform", "risk", "benchmark_risk", "total", "benchmark_total"]
    eight = ["annual_of_gains", "benchmark_annual_of_gains", "annual_of_value"]
    return out.select(
        "cohorts", *[F.round(c, 6).alias(c) for c in six], *[F.round(c, 8).alias(c) for c in eight]
    )


@query(
    "b6o_sharpe",
    f"""with {CTES}, s as ({_RATE_SQL}), cal as (select distinct datadate as day from px),
    free as (select b.bond, c.day, pow(1 + s.rate / 100000 / 100, 1.0 / 365) - 1 as f from (select bond, min(day) as f
      from s group by 1) b join cal c on c.day >= b.f asof join s on s.bond = b.bond and s.day <= c.day),
    port as (select datadate, avg(average) as average from own group by 1)
    select bond, count(average) as days, round(avg(average - f) / stddev_samp(average - f), 6) as sharpe
    from free left join port on datadate = day group by 1""",
)
def b6(spark, d):
    daily = own(spark, d).groupBy("datadate").agg(F.avg("average").alias("average"))
    rates = monthly_rates(spark, d).select("bond", F.col("day").alias("datadate"), (F.col("rate") / 100000).alias("rate"))
    out = B.sharpe(daily, rates, B.trading_days(px(spark, d)), "bond", "rate")
    return out.withColumn("sharpe", F.round("sharpe", 6))


@query(
    "b7o_calendar_year_slices",
    f"""with {CTES} select cast(year(datadate) as integer) as yr, count(*) as days, round(avg(average), 8) as mean_average,
        round(avg(cumulative), 8) as mean_cumulative from own group by 1""",
)
def b7(spark, d):
    out = B.calendar_year_slices(own(spark, d))
    return out.select("yr", "days", *[F.round(c, 8).alias(c) for c in ("mean_average", "mean_cumulative")])
