"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feathergrid.functions.timefns import epoch_seconds
from feathergrid.operators import joins as J
from feathergrid.operators import rolling as RO
from feathergrid.plans import roles
from feathergrid.plans.registry import query
from feathergrid.plans.scalars import _haversine_sql
from feathergrid.session import table

PR, BM = roles.PRICES_SQL, roles.BENCHMARK_SQL


@query(
    "j1_inner_equi",
    "select o_orderkey, l_linenumber, l_quantity, o_orderpriority from orders join lineitem on l_orderkey = o_orderkey",
)
def j1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query(
    "j2_left_multi_key",
    f"""select a.cusip, cast(a.datadate as varchar) as datadate, a.revtq, b.revtq as revtq_last_year
        from ({roles.QUARTER_SQL}) a left join (select cusip, (datadate + interval 1 year)::date as datadate, revtq
        from ({roles.QUARTER_SQL})) b on a.cusip = b.cusip and a.datadate = b.datadate""",
)
def j2(spark, d):
    q = roles.quarters(spark, d).select("cusip", "datadate", "revtq")
    last = q.withColumn("datadate", F.add_months("datadate", 12))
    out = J.left_multi_key(q, last, ["cusip", "datadate"], "_last_year")
    return out.withColumn("datadate", F.col("datadate").cast("string"))


@query(
    "j3_left_benchmark",
    f"""select tic, cast(datadate as varchar) as datadate, round(prccd - bench, 8) + 0.0 as excess from ({PR})
        left join (select datadate, prccd as bench from ({BM})) using (datadate)""",
)
def j3(spark, d):
    bench = roles.benchmark(spark, d).withColumnRenamed("prccd", "bench")
    out = J.left_benchmark(roles.prices(spark, d), bench, "datadate")
    return out.select(
        "tic",
        F.col("datadate").cast("string").alias("datadate"),
        (F.round(F.col("prccd") - F.col("bench"), 8) + 0.0).alias("excess"),
    )


_EV = "select event_id, user_id, event_type, value, cast(floor(epoch(ts)) as bigint) as t from events"


def sides(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value", epoch_seconds(F.col("ts")).alias("t")
    )
    left = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "t")
    right = e.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("view_id"), "user_id", F.col("t").alias("view_t"), "value"
    )
    return left, right


def _pairs_sql(lo, hi):
    return f"""select l.event_id, l.t - r.t as lag, r.event_id as view_id, r.value from ({_EV}) l join ({_EV}) r
        on l.user_id = r.user_id and l.t - r.t between {lo} and {hi}
        where l.event_type = 'purchase' and r.event_type = 'view'"""


@query("j4_interval_join", _pairs_sql(7200, 14400))
def j4(spark, d):
    left, right = sides(spark, d)
    out = J.interval_join(left, right, ["user_id"], "t", "view_t", 7200, 14400)
    return out.select("event_id", (F.col("t") - F.col("view_t")).alias("lag"), "view_id", "value")


def _asof_sql(lo, hi):
    return f"""select p.event_id, m.lag::double as lag, m.view_id::double as view_id, m.value from (select event_id from events where event_type = 'purchase') p
        left join (select * from ({_pairs_sql(lo, hi)})
        qualify row_number() over (partition by event_id order by lag, view_id desc) = 1) m using (event_id)"""


def asof(spark, d, lo, hi):
    left, right = sides(spark, d)
    out = J.asof_join(left, right, ["user_id"], "t", "view_t", "view_id", lo, hi)
    return out.select(
        "event_id",
        (F.col("t") - F.col("match.view_t")).cast("double").alias("lag"),
        F.col("match.view_id").cast("double").alias("view_id"),
        F.col("match.value").alias("value"),
    )


@query("j5_asof_join_2h_4h", _asof_sql(7200, 14400))
def j5(spark, d):
    return asof(spark, d, 7200, 14400)


@query("j5_asof_join_2h_48h", _asof_sql(7200, 172800))
def j5b(spark, d):
    return asof(spark, d, 7200, 172800)


_REPORTS = f"select l_orderkey * 10 + l_linenumber as report, origin, dep_t - dep_t % 86400 as at from ({roles.FLIGHTS_SQL})"


@query(
    "j5_asof_join_all_ties",
    f"""with r as ({_REPORTS}), f as (select l_orderkey, l_linenumber, tail_num, origin, dep_t from ({roles.FLIGHTS_SQL})),
        best as (select f.l_orderkey, f.l_linenumber, f.tail_num, f.origin, f.dep_t, max(r.at) as at from f join r on f.origin = r.origin
                 and f.dep_t - r.at between 7200 and 259200 group by all)
        select b.l_orderkey, b.l_linenumber, b.tail_num, r.report from best b join r on r.origin = b.origin and r.at = b.at""",
)
def j5c(spark, d):
    f = roles.flights(spark, d)
    reports = f.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("report"),
        "origin",
        (F.col("dep_t") - F.col("dep_t") % RO.DAY).alias("at"),
    )
    left = f.select("l_orderkey", "l_linenumber", "tail_num", "origin", "dep_t").distinct()
    out = J.asof_join_all_ties(left, reports, ["origin"], "dep_t", "at", "report", 7200, 3 * RO.DAY)
    return out.select("l_orderkey", "l_linenumber", "tail_num", F.col("match.report").alias("report"))


@query(
    "j6_nearest_neighbor_geo",
    f"""select city, station, round(km, 4) as distance_km from (select c.city, s.station,
        {_haversine_sql('c.lat', 'c.lon', 's.lat', 's.lon')} as km from ({roles.CITIES_SQL}) c, ({roles.STATIONS_SQL}) s)
        qualify row_number() over (partition by city order by km, station) = 1""",
)
def j6(spark, d):
    out = J.nearest_point(roles.cities(spark, d), "city", roles.stations(spark, d), "station")
    return out.withColumn("distance_km", F.round("distance_km", 4))


@query(
    "j7_broadcast_lookup",
    "select o_orderkey, c_mktsegment from orders left join customer on c_custkey = o_custkey",
)
def j7(spark, d):
    dim = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), dim, "o_custkey").drop("o_custkey")


@query("j8_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def j8(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("j9_semi_join", "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def j9(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


@query(
    "j10_align_full_outer",
    """select cast(coalesce(a.day, o.day) as varchar) as day, a.qty as shipped, o.n as ordered from
       (select l_shipdate::date as day, sum(l_quantity) as qty from lineitem group by 1) a full join
       (select o_orderdate::date as day, count(*)::double as n from orders group by 1) o on a.day = o.day""",
)
def j10(spark, d):
    shipped = table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(
        F.sum("l_quantity").alias("v")
    )
    ordered = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("v")
    )
    out = J.align_full_outer({"shipped": shipped, "ordered": ordered}, "day", "v")
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "j11_ratio_of_two_aggs",
    f"""select yr::integer as yr, carrier, sum(dep_del15)::bigint as numerator, count(dep_del15)::bigint as denominator,
        round(sum(dep_del15) / count(dep_del15), 6) as rate from ({roles.FLIGHTS_SQL}) group by 1, 2""",
)
def j11(spark, d):
    flag = F.col("dep_del15")
    known = F.when(flag.isNotNull(), 1).otherwise(0)
    out = J.ratio_of_two_aggs(roles.flights(spark, d), ["yr", "carrier"], flag, known, "rate")
    return out.withColumn("rate", F.round("rate", 6))


_RATE_SQL = """select o_orderpriority as bond, date_trunc('month', o_orderdate)::date as day, max(o_totalprice) as rate
    from orders where year(o_orderdate) % 2 = 1 group by 1, 2"""


def monthly_rates(spark, d):
    o = table(spark, d, "orders").where(F.year("o_orderdate") % 2 == 1)
    return o.groupBy(
        F.col("o_orderpriority").alias("bond"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("day")
    ).agg(F.max("o_totalprice").alias("rate"))


@query(
    "j12_calendar_asof_fill",
    f"""with s as ({_RATE_SQL}), cal as (select distinct l_shipdate::date as day from lineitem)
        select b.bond, cast(c.day as varchar) as day, s.rate from (select bond, min(day) as f from s group by 1) b
        join cal c on c.day >= b.f asof join s on s.bond = b.bond and s.day <= c.day""",
)
def j12(spark, d):
    cal = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    out = J.calendar_asof_fill(cal, monthly_rates(spark, d), ["bond"], "day", "rate")
    return out.withColumn("day", F.col("day").cast("string"))
