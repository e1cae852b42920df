"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feathergrid.functions import columns as C
from feathergrid.functions import geo
from feathergrid.functions import text as X
from feathergrid.functions import timefns as TF
from feathergrid.operators import aggs as A
from feathergrid.plans import cleaning, roles
from feathergrid.plans.registry import query
from feathergrid.session import spread, table


@query("f1_concat_columns", "select s_suppkey, s_name || ' ' || cast(s_nationkey as varchar) as tag from supplier")
def f1(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.concat_ws(" ", "s_name", F.col("s_nationkey").cast("string")).alias("tag"))


@query(
    "f2_split_part",
    """select p_partkey, split_part(split_part(place, ',', 1), '/', 1) as city from (
       select p_partkey, case when p_partkey % 2 = 0 then p_name || '/' || p_type || ', ' || p_brand
       else p_name || ', ' || p_brand end as place from part)""",
)
def f2(spark, d):
    two = F.concat("p_name", F.lit("/"), "p_type", F.lit(", "), "p_brand")
    one = F.concat("p_name", F.lit(", "), "p_brand")
    place = F.when(F.col("p_partkey") % 2 == 0, two).otherwise(one)
    return table(spark, d, "part").select("p_partkey", C.first_city(place).alias("city"))


@query(
    "f3_strip_plus_cast_scale",
    f"select READING, try_cast(replace(split_part(TMP, ',', 1), '+', '') as double) / 10 as celsius from ({roles.WEATHER_SQL})",
)
def f3(spark, d):
    raw = F.split_part("TMP", F.lit(","), F.lit(1))
    return roles.weather(spark, d).select("READING", C.strip_plus_scaled(raw).alias("celsius"))


@query(
    "f4_pad_identifier",
    """select c_custkey, lpad(cast(c_custkey as varchar), 9, '0') as cusip9,
       left(lpad(cast(c_custkey as varchar), 9, '0'), 8) as cusip8 from customer""",
)
def f4(spark, d):
    nine = C.pad_identifier(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", nine.alias("cusip9"), C.drop_check_digit(nine).alias("cusip8"))


@query(
    "f5_token_recode",
    """select o_orderkey, round(100 * case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then 0.001
       else cast(o_orderkey % 100 as double) / 100 end, 6) as pct from orders""",
)
def f5(spark, d):
    k = F.col("o_orderkey")
    token = F.when(k % 5 == 0, "NR").when(k % 7 == 0, "<.01").otherwise(((k % 100) / 100).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.round(C.token_recode(token), 6).alias("pct"))


@query(
    "f6_text_normalize",
    r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        lower(text), '’', '''', 'g'), 'r/', 'the subcategory of: ', 'g'), 'u/.*?[\s\x{00a0}]', ' ', 'g'),
        'amp', ' ', 'g'), '\s+', ' ', 'g')) as text from documents""",
)
def f6(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    return docs.select("doc_id", X.text_normalize(F.col("text")).alias("text"))


# terms of the given texts, so that the replacement has work to do; all are single words
_WORDS = {"the": "this one", "and": "plus", "der": "dieser", "que": "what", "of": "from"}


@query(
    "f7_dictionary_replace",
    "select doc_id, "
    + "regexp_replace(" * 0
    + "list_aggregate(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_\\p{M}]+|[^\\p{L}\\p{N}_\\p{M}]+'), "
    + "lambda w: case w "
    + " ".join(f"when '{k}' then '{v}'" for k, v in _WORDS.items())
    + " else w end), 'string_agg', '') as text from documents",
)
def f7(spark, d):
    docs = spread(table(spark, d, "documents"), "doc_id")
    return docs.select("doc_id", X.dictionary_replace(F.col("text"), _WORDS).alias("text"))


#: Terms of the dictionary of phrases.
_TERMS = 6000


def phrase_dictionary(spark, d):
    """Words and runs of two and three words of the benchmark texts, the longest first, each with its replacement."""
    word = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ").alias("w")
    rows = table(spark, d, "benchmark").select(F.posexplode(word).alias("at", "first"), word)
    runs = F.array(*[F.array_join(F.slice("w", F.col("at") + 1, k), " ") for k in (1, 2, 3)])
    terms = rows.select(F.explode(runs).alias("term")).where("term <> ''").distinct()
    chosen = terms.orderBy(F.desc(F.length("term")), F.sha2("term", 256)).limit(_TERMS)  # the dictionary's size
    return {r["term"]: f"<{r['term'][:3].upper()}>" for r in chosen.orderBy(F.desc(F.length("term")), "term").collect()}


@query("f7_dictionary_phrases")
def f7_phrases(spark, d):
    """Thousands of words and phrases at once, on every text."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", X.dictionary_replace(F.col("text"), phrase_dictionary(spark, d)).alias("text"))


@query(
    "f8_changed_flag",
    """select lang, count(*) as n, sum(case when text = trim(lower(text)) then 0 else 1 end)::bigint as changed
       from documents group by lang""",
)
def f8(spark, d):
    flag = X.changed_flag(F.col("text"), F.trim(F.lower("text")))
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag).alias("changed")
    )


@query("f9_epoch_seconds", "select event_id, cast(floor(epoch(ts)) as bigint) as seconds from events")
def f9(spark, d):
    return table(spark, d, "events").select("event_id", TF.epoch_seconds(F.col("ts")).alias("seconds"))


_ZONES = ["America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "America/Phoenix"]
_ZONED_SQL = f"""
select event_id, ({_ZONES!r})[cast(user_id % 5 as integer) + 1] as zone,
       date_trunc('minute', timestamp '2015-03-07 20:00:00' + to_minutes(cast(event_id % 1440 as integer))
       + case when event_id % 2 = 0 then interval 0 day else interval 238 day end) as local from events"""


@query(
    "f10_local_to_utc",
    f"""
    select event_id, zone, case when back = local and later <> local and earlier <> local
           then strftime(u, '%Y-%m-%d %H:%M:%S') end as utc from (
      select event_id, zone, local, timezone('UTC', timezone(zone, local)) as u,
             timezone(zone, timezone(zone, local)) as back,
             timezone(zone, timezone(zone, local) + interval 1 hour) as later,
             timezone(zone, timezone(zone, local) - interval 1 hour) as earlier
      from ({_ZONED_SQL}))
    """,
)
def f10(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    zone = F.get(F.array(*[F.lit(z) for z in _ZONES]), (F.col("user_id") % 5).cast("int"))
    local = (
        F.expr("timestamp_ntz '2015-03-07 20:00:00'")
        + F.make_dt_interval(mins=(k % 1440).cast("int"))
        + F.make_dt_interval(days=F.when(k % 2 == 0, 0).otherwise(238))
    )
    text = F.date_format(local, "yyyy-MM-dd HHmm")
    rows = e.select("event_id", zone.alias("zone"), text.alias("local"))
    utc = TF.local_to_utc(F.col("local"), F.col("zone"))
    return rows.select("event_id", "zone", F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("f11_shift_time", f"select l_orderkey, dep_t - 7200 as predict_t from ({roles.FLIGHTS_SQL})")
def f11(spark, d):
    return roles.flights(spark, d).select("l_orderkey", TF.shift_seconds(F.col("dep_t"), -7200).alias("predict_t"))


_CLOCK_SQL = "cast(case when l_orderkey % 97 = 0 then 2400 else (l_orderkey % 24) * 100 + l_partkey % 60 end as varchar)"


def _clock():
    k = F.col("l_orderkey")
    return F.when(k % 97 == 0, 2400).otherwise((k % 24) * 100 + F.col("l_partkey") % 60).cast("string")


@query(
    "f12_hhmm_to_hour",
    f"""select l_orderkey, l_partkey, {_CLOCK_SQL} as clock,
        cast(left(lpad({_CLOCK_SQL}, 4, '0'), 2) as integer) % 24 as dep_hour from lineitem""",
)
def f12(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", _clock().alias("clock"), C.hhmm_to_hour(_clock()).alias("dep_hour")
    )


@query(
    "f13_part_of_day",
    """select part_of_day, count(*) as n, min(h)::integer as first_hour, max(h)::integer as last_hour from (
       select h, case when h >= 5 and h < 12 then 'Morning' when h >= 12 and h < 17 then 'Afternoon'
       when h >= 17 and h < 21 then 'Evening' else 'Night' end as part_of_day
       from (select hour(ts) as h from events)) group by 1""",
)
def f13(spark, d):
    h = F.hour("ts")
    e = table(spark, d, "events").select(h.alias("h"), C.part_of_day(h).alias("part_of_day"))
    return e.groupBy("part_of_day").agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("first_hour"), F.max("h").alias("last_hour")
    )


@query(
    "f14_make_date_parts",
    """select o_orderkey, cast(make_date(cast(year(o_orderdate) as integer), cast(month(o_orderdate) as integer), 1)
       as varchar) as month_start from orders""",
)
def f14(spark, d):
    day = F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1))
    return table(spark, d, "orders").select("o_orderkey", day.cast("string").alias("month_start"))


@query(
    "f15_add_years_months",
    """select o_orderkey, cast(cast(cast(o_orderdate as date) + interval 11 year as date) as varchar) as predict_start,
       cast(cast(cast(o_orderdate as date) + interval 1 month as date) as varchar) as predict_stop from orders""",
)
def f15(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.add_months(day, 12 * 11).cast("string").alias("predict_start"),
        F.add_months(day, 1).cast("string").alias("predict_stop"),
    )


@query(
    "f16_valid_trading_days",
    """select strftime(date_trunc('month', l_shipdate), '%Y-%m') as month, count(distinct l_shipdate) as trading_days
       from lineitem group by 1""",
)
def f16(spark, d):
    days = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("day").alias("trading_days"))


_HUMID = "exp((17.625 * {t}) / (243.04 + {t}))"
_CLEAN_SQL = f"""select READING, TMP_air_temperature / 10 as air, DEW_dew_point_temperature / 10 as dew,
    WND_speed / 10 as wind, SLP_sea_level_pressure / 10 as pressure, VIS_distance_dimension as visibility
    from ({cleaning._GOOD_SQL})"""


def readings(spark, d):
    w = cleaning.clean_weather(spark, d)
    return w.select(
        "READING",
        (F.col("TMP_air_temperature") / 10).alias("air"),
        (F.col("DEW_dew_point_temperature") / 10).alias("dew"),
        (F.col("WND_speed") / 10).alias("wind"),
        (F.col("SLP_sea_level_pressure") / 10).alias("pressure"),
        F.col("VIS_distance_dimension").alias("visibility"),
    )


@query(
    "f17_relative_humidity",
    f"select READING, round({_HUMID.format(t='dew')} / {_HUMID.format(t='air')}, 6) as humidity from ({_CLEAN_SQL})",
)
def f17(spark, d):
    return readings(spark, d).select(
        "READING", F.round(C.relative_humidity(F.col("dew"), F.col("air")), 6).alias("humidity")
    )


@query(
    "f18_bad_weather_flag",
    f"""select READING, case when {_HUMID.format(t='dew')} / {_HUMID.format(t='air')} > 0.5 and
        (wind >= 15.2 or pressure <= 1006.6 or visibility <= 1609.344) then 1 else 0 end as bad_weather
        from ({_CLEAN_SQL})""",
)
def f18(spark, d):
    flag = C.bad_weather_flag(*[F.col(c) for c in ("dew", "air", "wind", "pressure", "visibility")])
    return readings(spark, d).select("READING", flag.alias("bad_weather"))


def _haversine_sql(a, b, c, e):
    chord = (
        f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c}))"
        f" * sin(radians({e} - {b}) / 2) * sin(radians({e} - {b}) / 2))"
    )
    return f"2 * 6371 * atan2(sqrt({chord}), sqrt(1 - {chord}))"


@query(
    "f19_haversine_km",
    f"""select c.city, s.station, round({_haversine_sql('c.lat', 'c.lon', 's.lat', 's.lon')}, 4) as km
        from ({roles.CITIES_SQL}) c join ({roles.STATIONS_SQL}) s on c.city = s.station""",
)
def f19(spark, d):
    c, s = roles.cities(spark, d).alias("c"), roles.stations(spark, d).alias("s")
    km = geo.haversine_km(F.col("c.lat"), F.col("c.lon"), F.col("s.lat"), F.col("s.lon"))
    return c.join(s, F.col("c.city") == F.col("s.station")).select("city", "station", F.round(km, 4).alias("km"))


@query(
    "f20_clip",
    """select l_orderkey, l_linenumber, case when l_tax > 0.02 then least(greatest(l_discount, 0.02), 0.08) end as both,
       greatest(l_discount, 0.03) as low, least(l_discount, 0.05) as high from lineitem""",
)
def f20(spark, d):
    c = F.col("l_discount")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        C.clip(F.when(F.col("l_tax") > 0.02, c), 0.02, 0.08).alias("both"),
        C.clip(c, lower=0.03).alias("low"),
        C.clip(c, upper=0.05).alias("high"),
    )


@query(
    "f21_abs_ratio_of_base",
    f"""select cusip, cast(datadate as varchar) as datadate,
        round(coalesce(least(case when revtq <> 0 then abs(niq) / abs(revtq) when niq <> 0 then 5.0 end, 5.0), 0.0), 6) as pct,
        round(case when revtq > 100000 then coalesce(least(abs(niq) / (revtq - 100000), 5.0), 0.0) else 0.0 end, 6) as pct_pos
        from ({roles.QUARTER_SQL})""",
)
def f21(spark, d):
    q = roles.quarters(spark, d)
    low = F.col("revtq") - 100000
    return q.select(
        "cusip",
        F.col("datadate").cast("string").alias("datadate"),
        F.round(C.abs_ratio_of_base(F.col("niq"), F.col("revtq")), 6).alias("pct"),
        F.round(C.abs_ratio_of_positive_base(F.col("niq"), low), 6).alias("pct_pos"),
    )


@query(
    "f22_enterprise_value",
    f"select cusip, cast(datadate as varchar) as datadate, round(revtq - coalesce(cheq, 0) + coalesce(niq, 0), 4) as ev from ({roles.QUARTER_SQL})",
)
def f22(spark, d):
    ev = C.enterprise_value(F.col("revtq"), [F.col("cheq")], [F.col("niq")])
    return roles.quarters(spark, d).select(
        "cusip", F.col("datadate").cast("string").alias("datadate"), F.round(ev, 4).alias("ev")
    )


@query(
    "f23_adjusted_price",
    f"select tic, cast(datadate as varchar) as datadate, round(prccd / ajexdi, 6) as adjusted_price from ({roles.PRICES_SQL})",
)
def f23(spark, d):
    return roles.prices(spark, d).select(
        "tic",
        F.col("datadate").cast("string").alias("datadate"),
        F.round(F.col("prccd") / F.col("ajexdi"), 6).alias("adjusted_price"),
    )


@query(
    "f24_zscore",
    """select l_orderkey, l_linenumber, l_extendedprice, round((l_quantity - (select avg(l_quantity) from lineitem))
       / (select stddev_samp(l_quantity) from lineitem), 6) as z from lineitem""",
)
def f24(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    z = A.zscore(li, ["l_quantity"])
    return z.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round("l_quantity", 6).alias("z"))


@query(
    "f25_minmax_scale",
    """select p_partkey, round((p_size - (select min(p_size) from part)) / (select max(p_size) - min(p_size) from part), 6)
       as scaled, round((p_size - least(p_size, p_retailprice)) / (greatest(p_size, p_retailprice)
       - least(p_size, p_retailprice)), 6) as row_scaled from part""",
)
def f25(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    both = F.array(F.col("p_size").cast("double"), "p_retailprice")
    row = F.try_divide(F.col("p_size") - F.array_min(both), F.array_max(both) - F.array_min(both))
    scaled = A.minmax_scale(p.withColumn("row_scaled", F.round(row, 6)), ["p_size"])
    return scaled.select("p_partkey", F.round("p_size", 6).alias("scaled"), "row_scaled")


@query(
    "f26_softmax_row",
    """select l_returnflag, l_linestatus, round(exp(v) / sum(exp(v)) over (partition by l_returnflag), 6) as weight
       from (select l_returnflag, l_linestatus, avg(l_discount) * 10 as v from lineitem group by 1, 2)""",
)
def f26(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((F.avg("l_discount") * 10).alias("v"))
    weight = F.exp("v") / F.sum(F.exp("v")).over(W.partitionBy("l_returnflag"))
    return g.select("l_returnflag", "l_linestatus", F.round(weight, 6).alias("weight"))


@query(
    "f27_inf_replace",
    """with r as (select l_orderkey, l_linenumber, l_extendedprice, case when l_tax = 0 and l_discount > 0.05
         then 'infinity'::double when l_tax = 0 then '-infinity'::double else l_discount / l_tax end as r from lineitem)
       select l_orderkey, l_linenumber, l_extendedprice, round(case when r = 'infinity'::double
         then (select max(r) from r where not isinf(r)) when r = '-infinity'::double
         then (select min(r) from r where not isinf(r)) else r end, 6) as ratio from r""",
)
def f27(spark, d):
    tax, cut = F.col("l_tax"), F.col("l_discount")
    ratio = F.when((tax == 0) & (cut > 0.05), float("inf")).when(tax == 0, float("-inf")).otherwise(F.try_divide(cut, tax))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", ratio.alias("ratio"))
    return A.inf_replace(li, ["ratio"]).withColumn("ratio", F.round("ratio", 6))


@query("f28_round_flags", "select l_orderkey, l_linenumber, round_even(l_discount * 10, 0) as law from lineitem")
def f28(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.bround(F.col("l_discount") * 10, 0).alias("law")
    )


@query(
    "f29_log_box_cox",
    """select o_orderkey, round(ln(o_totalprice), 6) as logged, round((pow(o_totalprice, 0.5) - 1) / 0.5, 6) as boxed
       from orders""",
)
def f29(spark, d):
    c = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(C.box_cox(c, 0), 6).alias("logged"), F.round(C.box_cox(c, 0.5), 6).alias("boxed")
    )


@query(
    "f30_daily_rate",
    "select l_orderkey, l_linenumber, round(pow(1 + l_tax * 100 / 100, 1.0 / 365) - 1, 9) as rate from lineitem",
)
def f30(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(C.daily_rate(F.col("l_tax") * 100), 9).alias("rate")
    )


@query(
    "f31_literal_map_lookup",
    "select o_orderkey, case when year(o_orderdate) between 1995 and 2001 then cast(year(o_orderdate) - 1995 as integer) end as fold from orders",
)
def f31(spark, d):
    years = {y: y - 1995 for y in range(1995, 2002)}
    return table(spark, d, "orders").select("o_orderkey", C.map_literal(years, F.year("o_orderdate")).alias("fold"))


_VOCAB = ["click", "view", "purchase", "signup", "error", "other"]


@query(
    "f32_multi_hot",
    "select event_id, "
    + " || ".join(f"case when event_type = '{v}' or (event_id % 2 = 0 and '{v}' = 'other') then '1' else '0' end" for v in _VOCAB)
    + " as hot from events",
)
def f32(spark, d):
    tags = F.array("event_type", F.when(F.col("event_id") % 2 == 0, "other").otherwise("none"))
    return table(spark, d, "events").select("event_id", F.concat_ws("", C.multi_hot(tags, _VOCAB).cast("array<string>")).alias("hot"))


@query(
    "f33_distinct_array_fields",
    """select p_partkey, case when p_type = p_brand then p_type else p_type || ',' || p_brand end as types,
       split_part(p_name, ' ', 1) as texts from part""",
)
def f33(spark, d):
    def note(kind):
        return F.struct(F.col(kind).alias("type"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("text"))

    notes = F.array(note("p_type"), note("p_brand"), note("p_type"))
    p = table(spark, d, "part").select("p_partkey", notes.alias("notes"))
    return p.select(
        "p_partkey",
        F.concat_ws(",", F.array_distinct("notes.type")).alias("types"),
        F.concat_ws(",", F.array_distinct("notes.text")).alias("texts"),
    )


@query(
    "f34_repeat_by_multiplicity",
    f"select src, dst from (select src, dst, unnest(range(cast(w as bigint))) as i from ({roles.LINKS_SQL}))",
)
def f34(spark, d):
    e = roles.links(spark, d)
    return e.withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int")))).select("src", "dst")


@query(
    "f35_sigmoid",
    """select l_orderkey, l_linenumber, l_extendedprice,
       round(1 / (1 + exp(-(-1.0 + 2.0 * l_discount + 0.05 * l_quantity))), 6) as p from lineitem""",
)
def f35(spark, d):
    p = C.sigmoid([-1.0, 2.0, 0.05], [F.col("l_discount"), F.col("l_quantity")])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(p, 6).alias("p"))


@query(
    "f36_json_extract",
    "select event_id, cast(json_extract_string(props, '$.k') as varchar) as k from events",
)
def f36(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
