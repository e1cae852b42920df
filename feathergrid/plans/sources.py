"""Scans and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feathergrid.plans import roles
from feathergrid.plans.registry import query
from feathergrid.session import scratch_path, table
from feathergrid.sources import readers, writers


@query(
    "s1_scan_parquet",
    "select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '1998-01-01'",
)
def s1(spark, d):
    li = readers.scan_parquet(spark, f"{d}/lineitem*.parquet")
    return li.where(F.col("l_shipdate") >= F.expr("timestamp_ntz '1998-01-01'")).select(
        "l_orderkey", "l_linenumber", "l_quantity"
    )


@query(
    "s2_scan_csv_typed",
    """select c_custkey, c_name, try_cast(case when c_custkey % 5 = 0 then 'n/a' else cast(c_acctbal as varchar) end
       as double) as c_acctbal, c_nationkey from customer""",
)
def s2(spark, d):
    path = scratch_path(spark, "csv")
    balance = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    c = table(spark, d, "customer").select("c_custkey", "c_name", balance.alias("c_acctbal"), "c_nationkey")
    c.write.csv(path, header=True, sep="\t")
    types = {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double", "c_nationkey": "int"}
    return readers.scan_csv_typed(spark, path, types, sep="\t")


@query(
    "s3_scan_adjacency_text",
    f"select cast(src as varchar) as src, cast(dst as varchar) as dst, cast(w as bigint) as w from ({roles.LINKS_SQL})",
)
def s3(spark, d):
    path = writers.write_adjacency_text(roles.links(spark, d), scratch_path(spark, "adjacency"))
    return readers.scan_adjacency_text(spark, path)


@query(
    "s4_scan_json_nested",
    """select event_id, user_id, k, kind, normalized_text from (
       select event_id, user_id, cast(json_extract(props, '$.k') as integer) as k,
              unnest(['Event', 'Day']) as kind, unnest([event_type, strftime(ts, '%Y-%m-%d')]) as normalized_text
       from events)""",
)
def s4(spark, d):
    def note(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("normalized_text"))

    e = table(spark, d, "events")
    notes = F.array(note("Event", F.col("event_type")), note("Day", F.date_format("ts", "yyyy-MM-dd")))
    path = scratch_path(spark, "json")
    e.select(
        "event_id", F.col("user_id").alias("author_id"), "props", F.struct(notes.alias("annotations")).alias("entities")
    ).write.json(path)
    schema = (
        "event_id bigint, author_id bigint, props string, "
        "entities struct<annotations: array<struct<type: string, normalized_text: string>>>"
    )
    flat = readers.scan_json_nested(spark, path, schema, "entities.annotations")
    return flat.select(
        "event_id",
        F.col("author_id").alias("user_id"),
        F.from_json("props", "k int")["k"].alias("k"),
        F.col("item.type").alias("kind"),
        F.col("item.normalized_text").alias("normalized_text"),
    )


@query(
    "s5_scan_whitespace_text",
    """select o_orderkey as id, cast(cast(o_orderdate as date) as varchar) as date,
       case when o_orderstatus <> 'P' then o_totalprice end as value from orders""",
)
def s5(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy   MM dd")
    value = F.when(F.col("o_orderstatus") == "P", "-999.99").otherwise(F.col("o_totalprice").cast("string"))
    rows = o.select(F.concat_ws("  ", day, F.col("o_orderkey").cast("string"), value).alias("value"))
    notes = table(spark, d, "region").select(F.concat(F.lit("# "), "r_name").alias("value"))
    path = scratch_path(spark, "text")
    notes.unionByName(rows).write.text(path)
    types = {"year": "int", "month": "int", "day": "int", "id": "bigint", "value": "double"}
    out = readers.scan_whitespace_text(spark, path, list(types), types, missing=-999.99)
    return out.select("id", F.col("date").cast("string").alias("date"), "value")


@query("s6_write_parquet", "select o_orderkey, o_totalprice from orders")
def s6(spark, d):
    path = scratch_path(spark, "parquet")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    writers.write_parquet(o, path)
    writers.write_parquet(o, path, mode="overwrite")
    return readers.scan_parquet(spark, path)


@query("s7_write_versioned_read_latest", "select o_orderkey, o_totalprice * 2 as o_totalprice from orders")
def s7(spark, d):
    root = scratch_path(spark, "versions")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    writers.write_versioned(o, root, "1658902110")
    writers.write_versioned(o.withColumn("o_totalprice", F.col("o_totalprice") * 2), root, "1659216789")
    return writers.read_latest(spark, root)


@query(
    "s8_checkpoint_verified",
    "select event_type, count(*) as rows_before, count(*) as rows_after from events group by event_type",
)
def s8(spark, d):
    return writers.checkpoint_verified(table(spark, d, "events"), "event_type")[1]


@query(
    "s9_sql_view",
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty, count(*) as n
       from lineitem group by 1, 2 having count(*) > 10""",
)
def s9(spark, d):
    return writers.sql_view(
        table(spark, d, "lineitem"),
        "shipments",
        """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty, count(*) as n
           from shipments group by l_returnflag, l_linestatus having count(*) > 10""",
    )


@query(
    "s10_scan_html_links",
    """select page_id, cast(generate_subscripts(h, 1) - 1 as integer) as position, unnest(h) as href, unnest(a) as anchor
       from (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as h,
                    regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as a from pages)""",
)
def s10(spark, d):
    return readers.scan_html_links(table(spark, d, "pages"), "page_id", "html")
