"""Aggregation, sort, limit and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feathergrid.operators import aggs as A
from feathergrid.operators import project as P
from feathergrid.operators import rows as R
from feathergrid.plans import roles
from feathergrid.plans.registry import query
from feathergrid.session import table

FL = roles.FLIGHTS_SQL
PROFILED = ["dep_del15", "weather_delay", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a1_group_count_sorted", "select l_suppkey, count(*) as n from lineitem group by 1 having count(*) > 580")
def a1(spark, d):
    return A.group_count_sorted(table(spark, d, "lineitem"), ["l_suppkey"], more_than=580)


@query(
    "a2_pct_frequency",
    """select l_quantity, count(l_quantity) as n,
       round_even(count(l_quantity) * 100 / (select count(*) from lineitem), 2) as percentage from lineitem group by 1""",
)
def a2(spark, d):
    return A.pct_frequency(table(spark, d, "lineitem"), "l_quantity")


@query(
    "a3_crosstab",
    """select l_linenumber, count(*) filter (l_returnflag = 'A') as "A", count(*) filter (l_returnflag = 'N') as "N",
       count(*) filter (l_returnflag not in ('A', 'N') or l_returnflag is null) as other from lineitem group by 1""",
)
def a3(spark, d):
    return A.crosstab(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag", ["A", "N"])


SUMMARISED = ["dep_del15", "arr_del15", "weather_delay", "l_quantity", "l_extendedprice", "l_tax"]


@query(
    "a4_summary_stats",
    " union all ".join(
        f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as stddev,
        min({c})::double as min, max({c})::double as max, round(quantile_cont({c}::double, 0.1), 6) as p10,
        round(quantile_cont({c}::double, 0.25), 6) as p25, round(quantile_cont({c}::double, 0.5), 6) as p50,
        round(quantile_cont({c}::double, 0.75), 6) as p75, round(quantile_cont({c}::double, 0.9), 6) as p90 from ({FL})"""
        for c in SUMMARISED
    ),
)
def a4(spark, d):
    out = A.summary_stats(roles.flights(spark, d), SUMMARISED)
    rounded = ["mean", "stddev", *A.SUMMARY_QUANTILES]
    return out.select("column", "n", "min", "max", *[F.round(c, 6).alias(c) for c in rounded])


@query(
    "a5_null_profile",
    " union all ".join(
        f"""select '{c}' as "column", count(*) - count({c}) as nulls,
        round((count(*) - count({c})) / count(*), 6) as share from ({FL})"""
        for c in PROFILED
    ),
)
def a5(spark, d):
    out = A.null_profile(roles.flights(spark, d).select(*PROFILED))
    return out.withColumn("share", F.round("share", 6))


@query(
    "a6_blank_profile",
    " union all ".join(
        f"select '{c}' as \"column\", count(*) filter ({c} = '') as blanks from ({roles.WEATHER_SQL})" for c in ("NAME", "WND")
    ),
)
def a6(spark, d):
    return A.blank_profile(roles.weather(spark, d), ["NAME", "WND"])


@query(
    "a7_global_multi_sum",
    """select round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice), 2) as price, round(sum(l_tax), 2) as tax,
       sum(l_linenumber)::bigint as lines from lineitem""",
)
def a7(spark, d):
    return table(spark, d, "lineitem").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.sum("l_tax"), 2).alias("tax"),
        F.sum("l_linenumber").alias("lines"),
    )


@query(
    "a8_count_distinct",
    "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by 1",
)
def a8(spark, d):
    li = table(spark, d, "lineitem")
    return R.count_distinct_by(li, ["l_returnflag"], {"parts": "l_partkey", "suppliers": "l_suppkey"})


@query(
    "a9_conditional_rate",
    f"select origin, count(dep_del15) as n, round(avg(dep_del15), 6) as rate from ({FL}) group by 1 having count(dep_del15) > 400",
)
def a9(spark, d):
    out = A.conditional_rate(roles.flights(spark, d), ["origin"], F.col("dep_del15"), more_than=400)
    return out.withColumn("rate", F.round("rate", 6)).orderBy(F.desc("rate"), "origin")


@query(
    "a10_collect_set",
    "select user_id, string_agg(distinct event_type, ',' order by event_type) as types from events group by 1",
)
def a10(spark, d):
    kinds = F.array_sort(F.collect_set("event_type"))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(kinds, ",").alias("types"))


@query(
    "a11_group_moments",
    """select l_returnflag, l_linestatus, count(l_extendedprice) as n, round(avg(l_extendedprice), 4) as mean,
       round(stddev_samp(l_extendedprice), 4) as stddev, min(l_extendedprice) as min, max(l_extendedprice) as max,
       round(median(l_extendedprice), 4) as median from lineitem group by 1, 2""",
)
def a11(spark, d):
    out = A.group_moments(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    for c in ("mean", "stddev", "median"):
        out = out.withColumn(c, F.round(c, 4))
    return out


@query(
    "a12_corr_pair",
    """select count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r,
       round(corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - pow(corr(l_quantity, l_extendedprice), 2))), 3)
       as t from lineitem""",
)
def a12(spark, d):
    out = A.corr_test(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", F.round("r", 6).alias("r"), F.round("t", 3).alias("t"))


_CORR = ["dep_del15", "arr_del15", "weather_delay", "l_quantity", "l_extendedprice", "l_tax", "price_again", "price_down"]
_CORR_SQL = f"select *, l_extendedprice + l_quantity as price_again, l_tax - l_extendedprice as price_down from ({FL})"
_PAIRS_SQL = " union all ".join(
    f"select '{a}' as f1, '{b}' as f2, corr(coalesce({a}, 0), coalesce({b}, 0)) as r from base"
    for i, a in enumerate(_CORR)
    for b in _CORR[i + 1 :]
)


def pairs(spark, d):
    price = F.col("l_extendedprice")
    f = roles.flights(spark, d).withColumn("price_again", price + F.col("l_quantity"))
    return A.corr_pairs(f.withColumn("price_down", F.col("l_tax") - price), _CORR)


@query("a13_corr_matrix", f"with base as ({_CORR_SQL}), p as ({_PAIRS_SQL}) select f1, f2, round(r, 6) as r from p")
def a13(spark, d):
    return pairs(spark, d).withColumn("r", F.round("r", 6))


#: 64 components, their squares and two more: the width of the published feature table.
_WIDE = 130


@query(
    "a13_corr_matrix_wide",
    """with e as (select vec_id, embedding::double[] as v, label from embeddings),
       c as materialized (select vec_id, unnest(range(130)) as i,
         unnest(list_concat(list_concat(v, list_transform(v, lambda x: x * x)), [label::double, (vec_id % 10)::double])) as x from e)
       select 'c' || a.i as f1, 'c' || b.i as f2, round(corr(a.x, b.x), 6) as r
       from c a join c b on a.vec_id = b.vec_id and a.i < b.i group by a.i, b.i""",
)
def a13_wide(spark, d):
    """All pairs of 130 columns."""
    e = table(spark, d, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(64)]
    wide = [*v, *[x * x for x in v], F.col("label"), F.col("vec_id") % 10]
    rows = e.select(*[x.alias(f"c{i}") for i, x in enumerate(wide)])
    return A.corr_pairs(rows, [f"c{i}" for i in range(_WIDE)]).withColumn("r", F.round("r", 6))


@query(
    "a14_high_corr_pairs",
    f"with base as ({_CORR_SQL}), p as ({_PAIRS_SQL}) select f1, f2, round(r, 6) as r from p where abs(r) > 0.7",
)
def a14(spark, d):
    return A.high_corr_pairs(pairs(spark, d)).withColumn("r", F.round("r", 6))


@query(
    "a14_correlation_partners",
    f"""with base as ({_CORR_SQL}), p as ({_PAIRS_SQL}),
        b as (select f1 as feature, r from p union all select f2, r from p)
        select feature, count(*) filter (r >= 0.7) as partners from b group by 1
        having count(*) filter (r >= 0.7) > 0 and count(*) filter (r < -0.9999) = 0""",
)
def a14b(spark, d):
    return A.correlation_partners(pairs(spark, d), strong=0.7, negative=-0.9999)


@query(
    "a15_skewness",
    """select round((sum(pow(x - m, 3)) / count(*)) / pow(sum(pow(x - m, 2)) / count(*), 1.5), 6) as skew
       from (select l_extendedprice as x, avg(l_extendedprice) over () as m from lineitem)""",
)
def a15(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.skewness("l_extendedprice"), 6).alias("skew"))


@query(
    "a16_histogram",
    """with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)
       select cast(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) as integer) as bin, count(*) as n
       from lineitem, b group by 1""",
)
def a16(spark, d):
    return A.histogram(table(spark, d, "lineitem"), "l_extendedprice", 50)


@query(
    "a17_empirical_cdf",
    "select distinct o_totalprice, round(cume_dist() over (order by o_totalprice), 6) as cdf from orders",
)
def a17(spark, d):
    return A.empirical_cdf(table(spark, d, "orders"), "o_totalprice").withColumn("cdf", F.round("cdf", 6))


@query(
    "a18_box_stats",
    """select l_returnflag, min(l_extendedprice) as low, round(quantile_cont(l_extendedprice, 0.25), 4) as q1,
       round(quantile_cont(l_extendedprice, 0.5), 4) as median, round(quantile_cont(l_extendedprice, 0.75), 4) as q3,
       max(l_extendedprice) as high from lineitem group by 1""",
)
def a18(spark, d):
    out = A.box_stats(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "low", "high", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")])


@query(
    "a19_min_max_flag_by_group",
    """select o_custkey, min(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as ever_min,
       max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as ever_max from orders group by 1
       having min(case when o_orderpriority = '1-URGENT' then 1 else 0 end) <>
              max(case when o_orderpriority = '1-URGENT' then 1 else 0 end)""",
)
def a19(spark, d):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    spans = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(urgent).alias("ever_min"), F.max(urgent).alias("ever_max"))
    return spans.where(F.col("ever_min") != F.col("ever_max"))


@query(
    "a20_flag_count_by_year",
    "select cast(year(o_orderdate) as integer) as yr, count(*) as n from orders where o_orderstatus = 'P' group by 1",
)
def a20(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == "P")
    return o.groupBy(F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a21_weighted_rate_by_x",
    """select l_quantity, round(sum(case when l_returnflag = 'R' then l_linenumber else 0 end) / sum(l_linenumber), 6)
       as rate from lineitem group by 1""",
)
def a21(spark, d):
    won = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(0)
    rate = F.try_divide(F.sum(won), F.sum("l_linenumber"))
    return table(spark, d, "lineitem").groupBy("l_quantity").agg(F.round(rate, 6).alias("rate"))


@query(
    "a22_resample_month",
    """select strftime(date_trunc('month', o_orderdate), '%Y-%m') as month, round(avg(o_totalprice), 4) as mean
       from orders group by 1""",
)
def a22(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("mean")
    )


@query(
    "a23_text_length_by_group",
    """select lang, round(avg(length(text)), 4) as mean_all,
       round(avg(case when quality <> toxic then length(text) end), 4) as mean_wrong
       from documents left join labels using (doc_id) group by 1""",
)
def a23(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("chars"))
    joined = docs.join(table(spark, d, "labels"), "doc_id", "left")
    wrong = F.col("quality") != F.col("toxic")
    return joined.groupBy("lang").agg(
        F.round(F.avg("chars"), 4).alias("mean_all"), F.round(F.avg(F.when(wrong, F.col("chars"))), 4).alias("mean_wrong")
    )


@query(
    "a24_utility_score",
    """with p as (select l_shipdate, sum(l_quantity * (l_discount - 0.04) *
                  case when l_returnflag = 'R' then 1 else 0 end) as p from lineitem group by 1),
       s as (select count(*) as dates, sum(p) as sp, sqrt(sum(p * p)) as sq from p)
       select dates, round(sp / sq * sqrt(250.0 / dates), 6) as t,
              round(least(greatest(sp / sq * sqrt(250.0 / dates), 0), 6) * sp, 4) as utility from s""",
)
def a24(spark, d):
    trades = table(spark, d, "lineitem").select(
        "l_shipdate",
        "l_quantity",
        (F.col("l_discount") - 0.04).alias("resp"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("action"),
    )
    out = A.utility_score(trades, "l_shipdate", "l_quantity", "resp", "action")
    return out.select("dates", F.round("t", 6).alias("t"), F.round("utility", 4).alias("utility"))


@query(
    "a25_hub_totals",
    """select airport, sum(n)::bigint as total from (select c_nationkey as airport, count(*) as n from customer group by 1
       union all select s_nationkey, count(*) from supplier group by 1) group by 1""",
)
def a25(spark, d):
    return R.hub_totals(table(spark, d, "customer"), "c_nationkey", table(spark, d, "supplier"), "s_nationkey", "airport")


@query("a26_total_text_volume", "select sum(length(text))::bigint as chars, count(*) as n from documents")
def a26(spark, d):
    return table(spark, d, "documents").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))


@query(
    "a27_unpivot",
    """select l_orderkey, l_linenumber, l_extendedprice, 'l_discount' as name, l_discount as value from lineitem
       union all select l_orderkey, l_linenumber, l_extendedprice, 'l_tax', l_tax from lineitem""",
)
def a27(spark, d):
    ids = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return table(spark, d, "lineitem").unpivot(ids, ["l_discount", "l_tax"], "name", "value")


# --- sort, limit, sample ---------------------------------------------------------------------------
@query("t1_order_by_multi", "select o_orderkey, o_orderpriority, o_totalprice from orders")
def t1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return o.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@query(
    "t2_top_k",
    "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
)
def t2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.top_k(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


@query("t3_sample_n", "select o_orderkey from orders order by md5('7:' || cast(o_orderkey as varchar)), o_orderkey limit 500")
def t3(spark, d):
    return R.sample_n(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 500, seed=7)


@query("t4_sort_within_entity", "select o_custkey, o_orderkey, o_totalprice from orders")
def t4(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return R.sort_within_entity(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


# --- set operations --------------------------------------------------------------------------------
@query(
    "u1_union_by_name",
    "select c_nationkey as nation, c_name as name from customer union all select s_nationkey, s_name from supplier",
)
def u1(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s)


@query(
    "u2_union_all",
    "select c_custkey as k from customer union all select s_suppkey from supplier union all select p_partkey from part",
)
def u2(spark, d):
    names = [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")]
    return R.union_all([table(spark, d, t).select(F.col(k).alias("k")) for t, k in names])


@query(
    "u3_distinct_rows",
    "select distinct l_orderkey, l_linenumber, l_partkey, l_quantity from (select * from lineitem union all select * from lineitem)",
)
def u3(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return li.unionAll(li).dropDuplicates()


@query(
    "u4_dedup_keep_last",
    """select o_custkey, o_orderkey, o_totalprice from orders
       qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""",
)
def u4(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return R.dedup_keep_last(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("u5_distinct_pairs", "select distinct l_suppkey, l_partkey from lineitem")
def u5(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
