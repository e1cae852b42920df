"""Walk-forward models over monthly rows of prices, and the portfolio picked by their scores."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from feathergrid.ml.walkforward import Cycles, WalkForward
from feathergrid.operators import backtest as B
from feathergrid.operators.project import universe_filter
from feathergrid.operators.series import last_day_in_period
from feathergrid.plans import roles
from feathergrid.plans.portfolio import BX_SQL, PX_SQL, mean_price, px
from feathergrid.plans.registry import query
from feathergrid.plans.solving import newton_ctes, pairs, solve_sql
from feathergrid.session import scratch_path

# fixed values: cycles, years of training, lowest price and market capitalisation
CYCLES = Cycles(date(1985, 1, 1), count=300, train_years=10)
MIN_PRICE, MIN_CAP, STEPS, LEAST = 5, 300, 6, 30


def sold(spark, d):
    """Price and volume by ticker and day, written once: labels, benchmark and holding months all read them."""
    rows = px(spark, d, "volume")
    path = scratch_path(spark, "walk-prices")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def monthly_rows(prices):
    """The last row of each ticker and month inside the universe, with its label a year ahead; one shuffle by ticker, no join back."""
    labelled = B.outperform_label(prices, mean_price(prices), "datadate", "price", "tic", keep=["price", "volume"])
    last = last_day_in_period(labelled.where("tic is not null and datadate is not null"), ["tic"], "datadate").where("is_last = 1")
    return universe_filter(last.withColumn("market_cap", F.col("price") * F.col("volume")), "price", "market_cap", MIN_PRICE, MIN_CAP)


def walk(prices):
    return WalkForward(monthly_rows(prices), "tic", "datadate", "outperformed", ["price", "volume"], CYCLES, least=LEAST)


_FIRST, _AHEAD = CYCLES.first, CYCLES.ahead
ROWS_SQL = f"""
px as materialized ({PX_SQL}), bx as materialized ({BX_SQL}),
o as (select tic, datadate, price, (lead(price, 250) over (partition by tic order by datadate) - price) / abs(price) as r from px),
bo as (select datadate, (lead(price, 250) over (order by datadate) - price) / abs(price) as r from bx),
monthly as (select o.tic, year(o.datadate) * 12 + month(o.datadate) - 1 as m, price, volume::double as volume,
    case when o.r > bo.r then 1.0 else 0.0 end as y
  from o join bo using (datadate) join (select tic, datadate, volume from ({roles.PRICES_SQL})) v on v.tic = o.tic and v.datadate = o.datadate
  qualify o.datadate = max(o.datadate) over (partition by o.tic, date_trunc('month', o.datadate))),
kept as (select * from monthly where price >= {MIN_PRICE} and price * volume >= {MIN_CAP}),
scaled as materialized (select tic, m, y::double as y, (price - avg(price) over ()) / stddev_samp(price) over () as z1,
    (volume - avg(volume) over ()) / stddev_samp(volume) over () as z2 from kept),
cyc as (select c::integer as cycle, {_FIRST} + c as t, {_FIRST} + {_AHEAD} + c as p from range({CYCLES.count}) r(c)),
tr0 as materialized (select cycle, tic, y, z1, z2 from cyc join scaled on m >= t and m < t + {CYCLES.length}),
means as materialized (select cycle, count(*) as n, sum(y) as hits, avg(y) as mean from tr0 group by 1),
enc as materialized (select cycle, tic, (sum(y) + any_value(mean)) / (count(*) + 1) as code from tr0 join means using (cycle) group by 1, 2),
tr as materialized (select cycle, 1.0::double as v0, z1 as v1, z2 as v2, code as v3, y from tr0 join enc using (cycle, tic)
  join means using (cycle) where n >= {LEAST} and hits > 0 and hits < n),
ahead as materialized (select cycle, m, scaled.tic, y, 1.0::double as v0, z1 as v1, z2 as v2, coalesce(code, mean) as v3 from scaled
  join cyc on m = p join means using (cycle) left join enc using (cycle, tic))
"""
_ETA = " + ".join(f"b{i} * v{i}" for i in range(4))
_SYSTEM = ", ".join(f"sum(v{i} * v{j}){' + 1.0' if i == j and i else ''} as a{i}_{j}" for i, j in pairs(4))
_LINEAR_SQL = solve_sql(f"select cycle, {_SYSTEM}, {', '.join(f'sum(v{i} * y) as r{i}' for i in range(4))} from tr group by 1", 4, "cycle")


def _report_sql(models: str, score: str, cut: float) -> str:
    coefs = ", ".join(f"round(b{i}, 5) + 0.0 as b{i}" for i in range(4))
    return f"""select cyc.cycle, cast(make_date((t // 12)::integer, (t % 12 + 1)::integer, 1) as varchar) as train_start,
        coalesce(n, 0)::bigint as train_rows, coalesce(hits, 0)::bigint as train_hits, coalesce(predicted, 0)::bigint as predicted,
        round(right_ones / predicted, 6) as accuracy, {coefs}
      from cyc left join means using (cycle) left join ({models}) using (cycle) left join
        (select cycle, count(*) as predicted, sum(case when ({score} >= {cut}) = (y > 0.5) then 1.0 else 0.0 end) as right_ones
         from ahead join ({models}) using (cycle) group by 1) using (cycle)"""


def report(walk: WalkForward, coef, scores, cut: float):
    """Windows, training rows, coefficients and accuracy of every cycle."""
    spark, c = walk.spark, walk.cycles
    rows = [
        (i, int(walk.n[i]), int(walk.hits[i]), *([round(float(b), 5) + 0.0 for b in row] if row[0] == row[0] else [None] * len(row)))
        for i, row in enumerate(coef)
    ]
    names = ", ".join(f"b{i} double" for i in range(coef.shape[1]))
    fits = spark.createDataFrame(rows, f"cycle int, train_rows long, train_hits long, {names}")
    hit = ((F.col("probability") >= cut) == (F.col("label") > 0.5)).cast("double")
    found = scores.groupBy("cycle").agg(F.count(F.lit(1)).alias("predicted"), F.round(F.avg(hit), 6).alias("accuracy"))
    windows = c.table(spark).select("cycle", F.col("train_start").cast("string").alias("train_start"))
    out = windows.join(fits, "cycle").join(found, "cycle", "left")
    return out.withColumn("predicted", F.coalesce("predicted", F.lit(0)))


@query("m12_walk_forward_linear", f"with {ROWS_SQL} {_report_sql(_LINEAR_SQL, _ETA, 0.5)}")
def m12_linear(spark, d):
    w = walk(sold(spark, d))
    coef = w.linear()
    return report(w, coef, w.scores(coef, "identity"), 0.5)


_LOGISTIC_CTES = newton_ctes("tr", 4, STEPS, keys="cycle", ridge=1.0)


@query(
    "m12_walk_forward_logistic",
    f"with {ROWS_SQL}, {_LOGISTIC_CTES} {_report_sql(f'select * from b{STEPS}', f'1 / (1 + exp(-({_ETA})))', 0.5)}",
)
def m12_logistic(spark, d):
    w = walk(sold(spark, d))
    coef, _ = w.logistic(STEPS)
    return report(w, coef, w.scores(coef), 0.5)


def walked_picks(spark, d):
    """Picks of each month by the model of its cycle."""
    prices = sold(spark, d)
    w = walk(prices)
    scored = w.scores(w.logistic(STEPS)[0])
    rounded = scored.select("month", F.col("entity").alias("ticker"), F.round("probability", 9).alias("probability"))
    return B.pick_top_k(rounded, prices)


@query(
    "b2o_walk_forward_picks",
    f"""with {ROWS_SQL}, {_LOGISTIC_CTES},
      score as materialized (select make_date((m // 12)::integer, (m % 12 + 1)::integer, 1) as month, tic as ticker,
        round(1 / (1 + exp(-({_ETA}))), 9) as probability from ahead join b{STEPS} using (cycle)),
      cand as (select (month + interval 1 month)::date as start_date, ticker, probability from score s where exists (
        select 1 from px where tic = ticker and datadate >= (s.month + interval 1 month)::date
        and datadate < (s.month + interval 13 month)::date))
      select cast(start_date as varchar) as start_date, ticker, round(probability, 6) as probability, pick from (
        select *, row_number() over (partition by start_date order by probability desc, ticker) as pick from cand) where pick <= 5""",
)
def b2_walked(spark, d):
    return walked_picks(spark, d).select(
        F.col("start_date").cast("string").alias("start_date"),
        "ticker",
        F.round("probability", 6).alias("probability"),
        F.col("pick").cast("long").alias("pick"),
    )
