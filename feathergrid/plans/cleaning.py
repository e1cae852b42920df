"""Projection, filter and cast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feathergrid.functions import columns as C
from feathergrid.functions import timefns as TF
from feathergrid.operators import project as P
from feathergrid.plans import roles
from feathergrid.plans.registry import query
from feathergrid.session import table

_PARTS = [n for names in C.PACKED_LAYOUT.values() for n in names]
_UNPACK_SQL = "select STATION, READING, NAME, " + ", ".join(
    f"string_split({p}, ',')[{i + 1}] as {n}" for p, names in C.PACKED_LAYOUT.items() for i, n in enumerate(names)
) + f" from ({roles.WEATHER_SQL})"
_FLOATS = [n for n in _PARTS if n.endswith("quality_code") or n in C.MISSING_READING]
_TYPED_SQL = "select STATION, READING, NAME, " + ", ".join(
    f"try_cast(replace({n}, '+', '') as double) as {n}" if n in _FLOATS else n for n in _PARTS
) + f" from ({_UNPACK_SQL})"
_GOOD_SQL = (
    f"select * from ({_TYPED_SQL}) where (right(NAME, 2) = 'US' or NAME = '') and "
    + " and ".join(f"{n} <> {v}" for n, v in C.MISSING_READING.items())
    + " and "
    + " and ".join(f"{n} in (0, 1, 4, 5, 9)" for n in _PARTS if n.endswith("quality_code"))
)


def typed_weather(spark, d):
    """Packed readings to typed columns."""
    return C.unpack_composite(roles.weather(spark, d), types={n: "double" for n in _FLOATS})


def clean_weather(spark, d):
    return P.keep_columns(C.quality_filter(typed_weather(spark, d)), ["STATION", "READING", "NAME", *_PARTS])


@query("p1_keep_columns", "select l_orderkey, l_quantity, l_returnflag from lineitem")
def p1(spark, d):
    return P.keep_columns(table(spark, d, "lineitem"), ["l_orderkey", "l_quantity", "l_returnflag"])


@query("p2_drop_columns", "select c_custkey, c_nationkey, c_acctbal from customer")
def p2(spark, d):
    return P.drop_columns(table(spark, d, "customer"), ["c_name", "c_mktsegment"])


@query(
    "p3_drop_sparse_columns",
    "select l_orderkey, l_linenumber, case when l_quantity > 10 then l_discount end as sometimes from lineitem",
)
def p3(spark, d):
    q = F.col("l_quantity")
    wide = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(q > 10, F.col("l_discount")).alias("sometimes"),
        F.when(q == 50, F.col("l_tax")).alias("rare"),
        F.lit(None).cast("double").alias("never"),
    )
    return P.drop_sparse_columns(wide)


@query("p4_rename_map", "select s_suppkey as station, s_name as name, s_nationkey, s_acctbal from supplier")
def p4(spark, d):
    return P.rename_map(table(spark, d, "supplier"), {"s_suppkey": "station", "s_name": "name"})


@query("p5_unpack_composite", _UNPACK_SQL)
def p5(spark, d):
    return P.drop_columns(C.unpack_composite(roles.weather(spark, d)), ["l_shipdate"])


@query(
    "p6_cast_tolerant",
    """select l_orderkey, l_linenumber, l_extendedprice, try_cast(case when l_partkey % 9 = 0 then 'abc'
       when l_partkey % 10 = 0 then '' else cast(l_quantity as varchar) end as double) as qty,
       try_cast(case when l_partkey % 7 = 0 then '1x' else cast(l_linenumber as varchar) end as integer)::double as line
       from lineitem""",
)
def p6(spark, d):
    k = F.col("l_partkey")
    text = F.when(k % 9 == 0, "abc").when(k % 10 == 0, "").otherwise(F.col("l_quantity").cast("string"))
    line = F.when(k % 7 == 0, "1x").otherwise(F.col("l_linenumber").cast("string"))
    raw = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", text.alias("qty"), line.alias("line")
    )
    return C.cast_tolerant(raw, {"qty": "double", "line": "int"}).withColumn("line", F.col("line").cast("double"))


@query("p6_cast_tolerant_readings", _TYPED_SQL)
def p6b(spark, d):
    return P.keep_columns(typed_weather(spark, d), ["STATION", "READING", "NAME", *_PARTS])


@query("p7_quality_filter", _GOOD_SQL)
def p7(spark, d):
    return clean_weather(spark, d)


@query(
    "p8_time_range_filter",
    """select o_orderkey, o_totalprice from orders
       where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'""",
)
def p8(spark, d):
    o = P.time_range_filter(
        table(spark, d, "orders"),
        "o_orderdate",
        F.expr("timestamp_ntz '1996-01-01'"),
        F.expr("timestamp_ntz '1997-01-01'"),
    )
    return o.select("o_orderkey", "o_totalprice")


@query(
    "p9_null_aware_filter",
    f"select l_orderkey, dep_del15 from ({roles.FLIGHTS_SQL}) where dep_del15 <> 1 and weather_delay is not null",
)
def p9(spark, d):
    f = roles.flights(spark, d)
    return f.where((F.col("dep_del15") != 1) & F.col("weather_delay").isNotNull()).select("l_orderkey", "dep_del15")


@query(
    "p10_case_indicator",
    f"""select l_orderkey, l_linenumber, case when dep_del15 = 1 and weather_delay > 0 then 1 else 0 end as weath_delay
        from ({roles.FLIGHTS_SQL})""",
)
def p10(spark, d):
    flag = C.indicator((F.col("dep_del15") == 1) & (F.col("weather_delay") > 0))
    return roles.flights(spark, d).select("l_orderkey", "l_linenumber", flag.alias("weath_delay"))


@query(
    "p11_drop_na",
    f"""select l_orderkey, l_linenumber, dep_del15, weather_delay from ({roles.FLIGHTS_SQL})
        where dep_del15 is not null and weather_delay is not null""",
)
def p11(spark, d):
    f = roles.flights(spark, d).select("l_orderkey", "l_linenumber", "dep_del15", "weather_delay")
    return P.drop_na(f, ["dep_del15", "weather_delay"])


@query(
    "p12_universe_filter",
    f"""select tic, cast(datadate as varchar) as datadate, prccd, volume from ({roles.PRICES_SQL})
        where prccd >= 30000 and volume >= 30 and tic in (1, 2, 3, 5, 8, 13, 21)""",
)
def p12(spark, d):
    kept = P.universe_filter(roles.prices(spark, d), "prccd", "volume", 30000, 30, "tic", [1, 2, 3, 5, 8, 13, 21])
    return kept.select("tic", F.col("datadate").cast("string").alias("datadate"), "prccd", "volume")


_POSTS_SQL = """select doc_id, source as title, lang, case when doc_id % 11 = 0 then '[removed]'
    when doc_id % 13 = 0 then '[deleted]' when doc_id % 7 = 0 then '' else text end as selftext from documents"""


def posts(spark, d):
    k = F.col("doc_id")
    body = F.when(k % 11 == 0, "[removed]").when(k % 13 == 0, "[deleted]").when(k % 7 == 0, "").otherwise(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("title"), "lang", body.alias("selftext")
    )


@query(
    "p13_text_validity_filter",
    f"""select doc_id, lang, coalesce(nullif(selftext, ''), title) as text from ({_POSTS_SQL})
        where selftext not in ('[removed]', '[deleted]')""",
)
def p13(spark, d):
    return P.text_validity_filter(posts(spark, d), "selftext", "title").select("doc_id", "lang", "text")


@query(
    "p14_cutoff_filter",
    """select o_orderkey from orders
       where cast(o_orderdate as date) <= cast(date '2000-06-30' - interval 2 year as date)""",
)
def p14(spark, d):
    day = F.col("o_orderdate").cast("date")
    known = TF.on_or_before_years(day, F.lit("2000-06-30").cast("date"), 2)
    return table(spark, d, "orders").where(known).select("o_orderkey")


@query("p15_drop_all_zero_columns", "select l_orderkey, l_quantity, 0 * l_quantity + l_tax as tax from lineitem")
def p15(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        F.col("l_tax").alias("tax"),
        (F.col("l_quantity") * 0).alias("empty"),
        F.lit(0).alias("zero"),
    )
    return P.drop_all_zero_columns(li)
