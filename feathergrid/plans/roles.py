"""How the given tables stand in for flights, weather, prices, links and posts.

Each role is given twice: as a DataFrame and as the SQL the checks start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feathergrid.functions.timefns import epoch_seconds
from feathergrid.session import spread, table

# --- flights: lineitem with a time of day -----------------------------------------------------
FLIGHTS_SQL = """
select l_orderkey, l_linenumber, l_partkey as tail_num, l_suppkey as origin, l_partkey % 50 as dest,
       l_linenumber as carrier, l_shipdate as fl_date, year(l_shipdate) as yr,
       cast(epoch(l_shipdate) as bigint) + ((l_partkey * 37 + l_orderkey * 13) % 1440) * 60 as dep_t,
       case when l_returnflag = 'R' then 1 when l_returnflag = 'A' or l_linestatus = 'F' then 0 end as dep_del15,
       case when l_linestatus = 'F' then 1 else 0 end as arr_del15,
       case when l_tax > 0.02 then l_tax * 100 end as weather_delay,
       case when l_returnflag = 'N' and l_linestatus = 'O' then 1.0 else 0.0 end as cancelled,
       l_quantity, l_extendedprice, l_discount, l_tax
from lineitem
"""


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    minute = (F.col("l_partkey") * 37 + F.col("l_orderkey") * 13) % 1440
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").alias("tail_num"),
        F.col("l_suppkey").alias("origin"),
        (F.col("l_partkey") % 50).alias("dest"),
        F.col("l_linenumber").alias("carrier"),
        F.col("l_shipdate").alias("fl_date"),
        F.year("l_shipdate").alias("yr"),
        (epoch_seconds(F.col("l_shipdate")) + minute * 60).alias("dep_t"),
        F.when(flag == "R", 1).when((flag == "A") | (status == "F"), 0).alias("dep_del15"),
        F.when(status == "F", 1).otherwise(0).alias("arr_del15"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 100).alias("weather_delay"),
        F.when((flag == "N") & (status == "O"), 1.0).otherwise(0.0).alias("cancelled"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )


# --- weather: packed readings per supplier "station" -------------------------------------------
# Expressions both engines read the same way; every missing mark and bad code occurs.
_WEATHER = {
    "STATION": "cast(l_suppkey as varchar(20))",
    "READING": "l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10",
    "NAME": "case when l_partkey % 7 = 0 then '' when l_partkey % 11 = 0 then 'YUKON, CA' else 'STATION, US' end",
    "WND": "concat(lpad(cast(case when l_orderkey % 19 = 0 then 999 else l_orderkey % 360 end as varchar(9)), 3, '0'),"
    " ',', cast(case when l_partkey % 23 = 0 then 2 else 1 end as varchar(9)), ',N,',"
    " lpad(cast(case when l_orderkey % 29 = 0 then 9999 else l_partkey % 200 end as varchar(9)), 4, '0'), ',5')",
    "CIG": "concat(lpad(cast(case when l_partkey % 31 = 0 then 99999 else l_partkey * 7 % 22000 end as varchar(9)), 5, '0'), ',1,M,N')",
    "VIS": "concat(lpad(cast(case when l_partkey % 37 = 0 then 999999 else l_orderkey * 11 % 16000 end as varchar(9)), 6, '0'), ',9,N,5')",
    "TMP": "concat(case when l_orderkey % 3 = 0 then '-' else '+' end, lpad(cast(case when l_orderkey % 41 = 0 then 9999 else l_orderkey % 350 end as varchar(9)), 4, '0'), ',1')",
    "DEW": "concat(case when l_partkey % 2 = 0 then '-' else '+' end, lpad(cast(l_partkey % 250 as varchar(9)), 4, '0'), ',', case when l_partkey % 43 = 0 then '7' else '1' end)",
    "SLP": "concat(lpad(cast(case when l_orderkey % 47 = 0 then 99999 else 9900 + l_orderkey % 400 end as varchar(9)), 5, '0'), ',1')",
}
WEATHER_SQL = "select l_shipdate, " + ", ".join(f"{e} as {n}" for n, e in _WEATHER.items()) + " from lineitem"


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return spread(li, "l_orderkey").selectExpr("l_shipdate", *[f"{e} as {n}" for n, e in _WEATHER.items()])


# --- places: coordinates from keys --------------------------------------------------------------
def _place(key: str) -> tuple[str, str]:
    return (f"cast({key} * 7919 % 15000 as double) / 100 - 75", f"cast({key} * 104729 % 36000 as double) / 100 - 180")


CITY_LAT, CITY_LON = _place("c_custkey")
STATION_LAT, STATION_LON = _place("s_suppkey")
CITIES_SQL = f"select c_custkey as city, {CITY_LAT} as lat, {CITY_LON} as lon from customer"
STATIONS_SQL = f"select s_suppkey as station, {STATION_LAT} as lat, {STATION_LON} as lon from supplier"


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as city", f"{CITY_LAT} as lat", f"{CITY_LON} as lon")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as station", f"{STATION_LAT} as lat", f"{STATION_LON} as lon"
    )


# --- prices: one row per supplier "ticker" and day ----------------------------------------------
PRICES_SQL = """
select l_suppkey as tic, cast(l_shipdate as date) as datadate,
       cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) / count(*) as prccd, max(1 + l_linenumber % 2) as ajexdi,
       cast(sum(cast(l_discount as decimal(18, 2))) as double) / count(*) as ratio, sum(l_quantity) as volume
from lineitem group by 1, 2
"""


def _exact_mean(col: str):
    """Mean of two-digit values through a decimal sum: the same bits whatever the order of rows."""
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one row per ticker and calendar day, so a window per ticker is bounded by the calendar."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("tic"), F.col("l_shipdate").cast("date").alias("datadate")).agg(
        _exact_mean("l_extendedprice").alias("prccd"),
        F.max(1 + F.col("l_linenumber") % 2).alias("ajexdi"),
        _exact_mean("l_discount").alias("ratio"),
        F.sum("l_quantity").alias("volume"),
    )


BENCHMARK_SQL = """
select cast(l_shipdate as date) as datadate, cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) / count(*) as prccd
from lineitem group by 1
"""


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean over all tickers."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_shipdate").cast("date").alias("datadate")).agg(
        _exact_mean("l_extendedprice").alias("prccd")
    )


# --- quarterly fundamentals ---------------------------------------------------------------------
QUARTER_SQL = """
select o_custkey as cusip, cast(date_trunc('quarter', o_orderdate) as date) as datadate,
       round(sum(case when o_orderstatus = 'P' then 0.0 else o_totalprice end), 2) as revtq,
       round(sum(case when o_orderstatus = 'F' then o_totalprice else -0.5 * o_totalprice end), 4) as niq,
       round(max(case when o_orderpriority = '1-URGENT' then o_totalprice end), 2) as cheq
from orders group by 1, 2
"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one row per entity and quarter."""
    o = table(spark, sf_dir, "orders")
    status, total = F.col("o_orderstatus"), F.col("o_totalprice")
    return o.groupBy(
        F.col("o_custkey").alias("cusip"),
        F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).cast("date").alias("datadate"),
    ).agg(
        F.round(F.sum(F.when(status == "P", 0.0).otherwise(total)), 2).alias("revtq"),
        F.round(F.sum(F.when(status == "F", total).otherwise(-0.5 * total)), 4).alias("niq"),
        F.round(F.max(F.when(F.col("o_orderpriority") == "1-URGENT", total)), 2).alias("cheq"),
    )


# --- links: customers point to the suppliers of their orders -------------------------------------
LINKS_SQL = """
select o_custkey as src, 1000000000 + l_suppkey as dst, count(*) as w
from orders join lineitem on l_orderkey = o_orderkey group by 1, 2
union all
select 1000000000 + s_suppkey, c_custkey, 1
from supplier join customer on c_custkey % 1000 = s_suppkey where s_suppkey % 3 <> 0
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): customer to supplier with multiplicity, and two of three suppliers back to customers."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + 1_000_000_000).alias("dst"))
    out = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dst"), (F.col("c_custkey") % 1000).alias("k"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select("s_suppkey")
    back = s.join(c, F.col("k") == F.col("s_suppkey")).select(
        (F.col("s_suppkey") + 1_000_000_000).alias("src"), "dst", F.lit(1).cast("long").alias("w")
    )
    return out.unionByName(back)
