"""Window queries: rolling features on flights, series features on daily prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from feathergrid.operators import rolling as RO
from feathergrid.operators import rows as R
from feathergrid.operators import series as S
from feathergrid.operators.joins import lookup
from feathergrid.plans import roles
from feathergrid.plans.registry import query
from feathergrid.session import table

FL = roles.FLIGHTS_SQL
PR = roles.PRICES_SQL
ID = ["l_orderkey", "l_linenumber", "tail_num", "origin", "l_extendedprice"]
IDS = ", ".join(ID)


def day_text(name="datadate"):
    return F.col(name).cast("string").alias(name)


def _over(key, frame, t="dep_t"):
    start, end = frame
    edge = "current row" if end == 0 else f"{-end} preceding"
    return f"over (partition by {key} order by {t} range between {-start} preceding and {edge})"


@query(
    "w1_rolling_avg_range",
    f"select {IDS}, round(avg(dep_del15) {_over('tail_num', RO.leaky_frame(30 * RO.DAY))}, 6) as rolling_average from ({FL})",
)
def w1(spark, d):
    f = roles.flights(spark, d).select(*ID, "dep_t", "dep_del15")
    out = RO.rolling_mean_of_flag(f, ["tail_num"], "dep_t", F.col("dep_del15"), 30 * RO.DAY, "rolling_average")
    return out.select(*ID, F.round("rolling_average", 6).alias("rolling_average"))


SPANS = {"2hrs": 2, "4hrs": 4, "8hrs": 8, "12hrs": 12}
FAMILIES = [
    ("origin", "dep_del15", "delay", "originport"),
    ("dest", "dep_del15", "delay", "destport"),
    ("carrier", "dep_del15", "delay", "orgairline"),
    ("origin", "arr_del15", "arrdelay", "originport"),
    ("origin_hub_status", "dep_del15", "delay", "originhub"),
]
_HUB_SQL = f"""(select *, case when origin in (select origin from (select origin, rank() over (order by n desc) as r
    from (select origin, count(*) as n from ({FL}) group by 1)) where r <= 15) then 'hub' else 'non-hub' end
    as origin_hub_status from ({FL}) where cancelled <> 1.0)"""


def _families_sql(frame):
    cols = [
        f"coalesce(sum({flag}) {_over(key, frame(h * 3600))}, 0)::bigint as {what}_{s}_{name}"
        for key, flag, what, name in FAMILIES
        for s, h in SPANS.items()
    ]
    return f"select {IDS}, {', '.join(cols)} from {_HUB_SQL}"


def rolling_families(spark, d, frame):
    """All five families; families on the same key share one exchange, and nothing is joined back."""
    f = roles.flights(spark, d)
    hubs = R.rank_global_label(f.groupBy("origin").agg(F.count(F.lit(1)).alias("n")), "origin", "n")
    kept = f.where(F.col("cancelled") != 1.0).select(*ID, "dest", "carrier", "dep_t", "dep_del15", "arr_del15")
    out = lookup(kept, hubs.select("origin", F.col("hub_status").alias("origin_hub_status")), "origin")
    frames = {s: frame(h * 3600) for s, h in SPANS.items()}
    for key in dict.fromkeys(k for k, *_ in FAMILIES):
        wanted = [(flag, what, name) for k, flag, what, name in FAMILIES if k == key]
        measures = {f"{what}_{name}": F.col(flag) for flag, what, name in wanted}
        names = {f"{what}_{name}_{s}": f"{what}_{s}_{name}" for _, what, name in wanted for s in SPANS}
        out = RO.with_rolling(out, [key], "dep_t", measures, frames).withColumnsRenamed(names)
    return out.select(*ID, *[f"{what}_{s}_{name}" for _, _, what, name in FAMILIES for s in SPANS])


@query("w2_rolling_sum_multi_leaky", _families_sql(RO.leaky_frame))
def w2(spark, d):
    return rolling_families(spark, d, RO.leaky_frame)


@query("w2_rolling_sum_multi_safe", _families_sql(RO.safe_frame))
def w2s(spark, d):
    return rolling_families(spark, d, RO.safe_frame)


_HOUR = _over("origin", RO.leaky_frame(RO.HOUR))


@query(
    "w3_rolling_ratio",
    f"""select {IDS}, count(origin) {_HOUR} as total_flights_perhr,
        sum(case when dep_del15 = 1 and weather_delay > 0 then 1 else 0 end) {_HOUR}::bigint as total_w_delay,
        round(sum(case when dep_del15 = 1 and weather_delay > 0 then 1 else 0 end) {_HOUR} / count(origin) {_HOUR} * 100, 6)
        as percent_wdelay from ({FL})""",
)
def w3(spark, d):
    f = roles.flights(spark, d).select(*ID, "dep_t", "dep_del15", "weather_delay")
    late = F.when((F.col("dep_del15") == 1) & (F.col("weather_delay") > 0), 1).otherwise(0)
    out = RO.with_rolling(
        f, ["origin"], "dep_t", {"flights": F.lit(1), "late": late}, {"hour": RO.leaky_frame(RO.HOUR)}
    )
    pct = F.try_divide("late_hour", "flights_hour") * 100
    return out.select(
        *ID,
        F.col("flights_hour").alias("total_flights_perhr"),
        F.col("late_hour").alias("total_w_delay"),
        F.round(pct, 6).alias("percent_wdelay"),
    )


@query(
    "w4_rank_global_label",
    """select l_suppkey, n, case when rank() over (order by n desc) <= 15 then 'hub' else 'non-hub' end as hub_status
       from (select l_suppkey, count(*) as n from lineitem group by 1)""",
)
def w4(spark, d):
    totals = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return R.rank_global_label(totals, "l_suppkey", "n")


@query(
    "w5_surrogate_row_id",
    "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as row_id from orders",
)
def w5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return R.dense_row_id(o, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "w6_lead_forward_return",
    f"""select tic, cast(datadate as varchar) as datadate, cast(lead(datadate, 250) over w as varchar) as later_date,
        round((lead(prccd, 250) over w - prccd) / abs(prccd), 6) as forward_return from ({PR})
        window w as (partition by tic order by datadate)""",
)
def w6(spark, d):
    out = S.lead_forward_return(roles.prices(spark, d), ["tic"], "datadate", "prccd")
    return out.select(
        "tic", day_text(), F.col("later_date").cast("string").alias("later_date"),
        F.round("forward_return", 6).alias("forward_return"),
    )


@query(
    "w7_pct_change",
    f"""select tic, cast(datadate as varchar) as datadate,
        round((prccd - lag(prccd) over w) / abs(lag(prccd) over w), 6) as change from ({PR})
        window w as (partition by tic order by datadate)""",
)
def w7(spark, d):
    w = S.along(["tic"], ["datadate"])
    return roles.prices(spark, d).select("tic", day_text(), F.round(S.pct_change("prccd", w), 6).alias("change"))


def _clamped(value, k):
    before = f"lag({value}, {k}) over w"
    return f"""round(coalesce(case when {before} is null then 0.0 when {before} <> 0
        then least(greatest(({value} - {before}) / abs({before}), -5.0), 5.0)
        when {value} <> 0 then sign({value}) * 5.0 end, 0.0), 6) + 0.0"""


@query(
    "w8_lag_k_change_clamped",
    f"""select cusip, cast(datadate as varchar) as datadate, {_clamped('revtq', 4)} as rev_yoy,
        {_clamped('revtq', 1)} as rev_qoq, {_clamped('niq', 1)} as ni_qoq
        from ({roles.QUARTER_SQL}) window w as (partition by cusip order by datadate)""",
)
def w8(spark, d):
    w = S.along(["cusip"], ["datadate"])
    return roles.quarters(spark, d).select(
        "cusip",
        day_text(),
        (F.round(S.lag_change_clamped("revtq", 4, w), 6) + 0.0).alias("rev_yoy"),
        (F.round(S.lag_change_clamped("revtq", 1, w), 6) + 0.0).alias("rev_qoq"),
        (F.round(S.lag_change_clamped("niq", 1, w), 6) + 0.0).alias("ni_qoq"),
    )


@query(
    "w9_sma_rows",
    "select tic, cast(datadate as varchar) as datadate, "
    + ", ".join(
        f"round(case when count(prccd) over (partition by tic order by datadate rows {n - 1} preceding) = {n} then "
        f"avg(prccd) over (partition by tic order by datadate rows {n - 1} preceding) end, 8) as sma_{n}"
        for n in (6, 12, 36)
    )
    + f" from ({PR})",
)
def w9(spark, d):
    w = S.along(["tic"], ["datadate"])
    smas = [F.round(S.sma_rows("prccd", n, w), 8).alias(f"sma_{n}") for n in (6, 12, 36)]
    return roles.prices(spark, d).select("tic", day_text(), *smas)


@query(
    "w10_rolling_stddev_range",
    f"""select tic, cast(datadate as varchar) as datadate, round(stddev_samp(prccd) over (partition by tic order by
        datadate range between interval 21 day preceding and current row), 4) as sd from ({PR})""",
)
def w10(spark, d):
    return roles.prices(spark, d).select(
        "tic", day_text(), F.round(S.rolling_stddev_days("prccd", "datadate", ["tic"]), 4).alias("sd")
    )


@query(
    "w11_annualized_volatility",
    f"""select tic, cast(datadate as varchar) as datadate, round(least(case when count(r) over w = 21
        then stddev_samp(r) over w * sqrt(252) end, case when count(r) over w = 21 then 1.0 end), 6) as volatility
        from (select tic, datadate, ln(prccd / lag(prccd) over (partition by tic order by datadate)) as r from ({PR}))
        window w as (partition by tic order by datadate rows 20 preceding)""",
)
def w11(spark, d):
    out = S.annualized_volatility(roles.prices(spark, d), ["tic"], "datadate", "prccd")
    return out.select("tic", day_text(), F.round("volatility", 6).alias("volatility"))


_GAPS = f"select tic, datadate, nullif(round(ratio * 100) % 4, 0.0) * volume as gap from ({PR})"


def gaps(spark, d):
    p = roles.prices(spark, d)
    gap = F.nullif(F.round(F.col("ratio") * 100) % 4, F.lit(0.0)) * F.col("volume")
    return p.select("tic", "datadate", gap.alias("gap"))


@query(
    "w12_forward_fill",
    f"""select tic, cast(datadate as varchar) as datadate, last_value(gap ignore nulls) over (partition by tic
        order by datadate rows unbounded preceding) as filled from ({_GAPS})""",
)
def w12(spark, d):
    w = S.along(["tic"], ["datadate"])
    return gaps(spark, d).select("tic", day_text(), S.forward_fill("gap", w).alias("filled"))


@query(
    "w13_backward_fill",
    f"""select tic, cast(datadate as varchar) as datadate, first_value(gap ignore nulls) over (partition by tic
        order by datadate rows between current row and unbounded following) as filled from ({_GAPS})""",
)
def w13(spark, d):
    w = S.along(["tic"], ["datadate"])
    return gaps(spark, d).select("tic", day_text(), S.backward_fill("gap", w).alias("filled"))


_FUNDS = f"""select cusip, datadate, nullif(revtq, 0) / 100000 as quick_ratio, niq / 200000 as roe,
    case when cheq > 300000 then revtq / cheq end as de_ratio from ({roles.QUARTER_SQL})"""
_CHAIN = {"quick_ratio": (None, 10, True), "roe": (-5, 5, False), "de_ratio": (-50, 50, False)}


def _chain_sql():
    def clip(c):
        lo, hi, _ = _CHAIN[c]
        low = f"greatest({c}, {lo})" if lo is not None else c
        return f"case when {c} is not null then least({low}, {hi}) end as {c}"

    def fill(c):
        w = "over (partition by cusip order by datadate rows"
        return (
            f"coalesce(last_value({c} ignore nulls) {w} unbounded preceding), "
            f"first_value({c} ignore nulls) {w} between current row and unbounded following)) as {c}"
        )

    filled = f"select cusip, datadate, {', '.join(fill(c) for c in _CHAIN)} from (select cusip, datadate, {', '.join(clip(c) for c in _CHAIN)} from ({_FUNDS}))"
    done = [
        f"round(coalesce({c}{f', avg({c}) over (partition by cusip)' if _CHAIN[c][2] else ''}, 0), 10) as {c}" for c in _CHAIN
    ]
    return f"select cusip, cast(datadate as varchar) as datadate, {', '.join(done)} from ({filled})"


@query("w14_fill_chain", _chain_sql())
def w14(spark, d):
    q = roles.quarters(spark, d).select(
        "cusip",
        "datadate",
        (F.nullif(F.col("revtq"), F.lit(0.0)) / 100000).alias("quick_ratio"),
        (F.col("niq") / 200000).alias("roe"),
        F.when(F.col("cheq") > 300000, F.col("revtq") / F.col("cheq")).alias("de_ratio"),
    )
    out = S.fill_chain(q, ["cusip"], "datadate")
    return out.select("cusip", day_text(), *[F.round(c, 10).alias(c) for c in _CHAIN])


@query(
    "w15_cumulative_return",
    f"""select tic, cast(datadate as varchar) as datadate, round(product(1 + coalesce(c, 0)) over (partition by tic
        order by datadate rows unbounded preceding) - 1, 6) as cumulative from (select tic, datadate, (volume - lag(volume)
        over (partition by tic order by datadate)) / lag(volume) over (partition by tic order by datadate) / 100 as c
        from ({PR}))""",
)
def w15(spark, d):
    w = S.along(["tic"], ["datadate"])
    p = roles.prices(spark, d).select("tic", "datadate", (S.pct_change("volume", w) / 100).alias("c"))
    return p.select("tic", day_text(), F.round(S.cumulative_return("c", w), 6).alias("cumulative"))


@query(
    "w16_last_day_in_period",
    f"""select tic, cast(datadate as varchar) as datadate, case when datadate = max(datadate) over (partition by tic,
        date_trunc('month', datadate)) then 1 else 0 end as is_last from ({PR})""",
)
def w16(spark, d):
    out = S.last_day_in_period(roles.prices(spark, d), ["tic"], "datadate")
    return out.select("tic", day_text(), "is_last")


_MONTHS = """select l_suppkey as tic, date_trunc('month', l_shipdate)::date as datadate, sum(l_quantity) as qty
    from lineitem group by 1, 2"""


def months(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("tic"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("datadate")
    ).agg(F.sum("l_quantity").alias("qty"))


@query(
    "w17_difference",
    f"""select tic, cast(datadate as varchar) as datadate, s12 - lag(s12) over (partition by tic order by datadate) as diff
        from (select tic, datadate, qty - lag(qty, 12) over (partition by tic order by datadate) as s12 from ({_MONTHS}))""",
)
def w17(spark, d):
    out = S.difference("qty", [12, 1], ["tic"], ["datadate"], months(spark, d), "diff")
    return out.select("tic", day_text(), "diff")


_DAILY = """select l_returnflag as series, l_shipdate::date as day, sum(l_quantity) as qty from lineitem group by 1, 2"""


def daily(spark, d):
    """One row per series and calendar day."""
    return table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("series"), F.col("l_shipdate").cast("date").alias("day")
    ).agg(F.sum("l_quantity").alias("qty"))


def acf_sql(source, key, day, value, lags):
    cols = " union all ".join(
        f"select {key}, {k} as lag, count(*) as n, sum(c * c{k}) / sum(c * c) as rho from g group by 1"
        for k in range(1, lags + 1)
    )
    shifted = ", ".join(f"lag(c, {k}) over (partition by {key} order by {day}) as c{k}" for k in range(1, lags + 1))
    return f"""with c as (select {key}, {day}, {value} - avg({value}) over (partition by {key}) as c from ({source})),
        g as (select {key}, c, {shifted} from c) {cols}"""


@query("w18_acf", f"select series, lag, n, round(rho, 6) as rho from ({acf_sql(_DAILY, 'series', 'day', 'qty', 10)})")
def w18(spark, d):
    return S.acf(daily(spark, d), ["series"], ["day"], "qty", 10).withColumn("rho", F.round("rho", 6))


@query(
    "w19_first_event",
    """select o_custkey, o_orderkey, cast(o_orderdate as varchar) as day from orders where o_orderstatus = 'P'
       qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1""",
)
def w19(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    first = R.first_event(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "P")
    return first.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("day"))


@query(
    "w20_top_k_per_group",
    """select month, l_suppkey, score, pick from (select *, row_number() over (partition by month order by score desc,
       l_suppkey) as pick from (select strftime(l_shipdate, '%Y-%m') as month, l_suppkey, max(l_extendedprice) as score
       from lineitem group by 1, 2)) where pick <= 5""",
)
def w20(spark, d):
    scored = table(spark, d, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_suppkey", F.col("l_extendedprice").alias("score")
    )
    return R.top_k_per_group(scored, ["month"], "l_suppkey", "score", 5).withColumn("pick", F.col("pick").cast("long"))


@query(
    "w21_cap_per_group",
    """select event_type, event_id from events
       qualify row_number() over (partition by event_type order by ts, event_id) <= 500""",
)
def w21(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "ts")
    return R.cap_per_group(e, ["event_type"], ["ts", "event_id"], 500).drop("ts")


@query(
    "w21_cap_per_group_blocked",
    """select l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
       qualify row_number() over (partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber, l_partkey,
       l_suppkey, l_extendedprice) <= 5000""",
)
def w21b(spark, d):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, d, "lineitem").select("l_returnflag", *order)
    out = R.cap_per_group(li, ["l_returnflag"], order, 5000, block=F.col("l_shipdate").cast("date"))
    return out.drop("l_shipdate", "l_suppkey")


@query(
    "w22_durbin_watson",
    f"""select series, round(sum(pow(e - p, 2)) / sum(e * e), 6) as dw from (select series, e, lag(e) over
        (partition by series order by day) as p from (select series, day, qty - avg(qty) over (partition by series) as e
        from ({_DAILY}))) group by 1""",
)
def w22(spark, d):
    day = daily(spark, d)
    means = day.groupBy("series").agg(F.avg("qty").alias("m"))
    resid = day.join(means, "series").withColumn("e", F.col("qty") - F.col("m"))
    return S.durbin_watson(resid, ["series"], ["day"], "e").withColumn("dw", F.round("dw", 6))
