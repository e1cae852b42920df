"""Scans: parquet, typed CSV, adjacency text, nested JSON, whitespace text, HTML links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A directory, a glob or a list of them; filters and columns are pushed into the scan."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def scan_csv_typed(
    spark: SparkSession, path: str, types: Mapping[str, str], sep: str = ",", encoding: str = "utf-8"
) -> DataFrame:
    """Read every column as text under a given schema, then cast; text that does not parse is null."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in types])
    raw = spark.read.schema(schema).csv(path, header=True, sep=sep, encoding=encoding)
    return raw.select(*[F.col(c).try_cast(t).alias(c) if t != "string" else F.col(c) for c, t in types.items()])


def parse_adjacency(line: Column) -> Column:
    """``node<TAB>{'dst': multiplicity, ...}`` to a map of destination to multiplicity."""
    body = F.replace(F.split_part(line, F.lit("\t"), F.lit(2)), F.lit("'"), F.lit('"'))
    return F.from_json(body, T.MapType(T.StringType(), T.LongType()))


def scan_adjacency_text(spark: SparkSession, path: str) -> DataFrame:
    """Adjacency lines to edges ``(src, dst, w)``; one node may span several lines."""
    lines = spark.read.text(path)
    src = F.split_part("value", F.lit("\t"), F.lit(1))
    return lines.select(src.alias("src"), F.explode(parse_adjacency(F.col("value"))).alias("dst", "w"))


def scan_json_nested(spark: SparkSession, path: str, schema: T.StructType | str, array: str) -> DataFrame:
    """JSON lines with an array of structs to one flat row per array element."""
    docs = spark.read.schema(schema).json(path)
    return docs.withColumn("item", F.explode(F.col(array)))


def scan_whitespace_text(
    spark: SparkSession, path: str, names: Sequence[str], types: Mapping[str, str], missing: float, comment: str = "#"
) -> DataFrame:
    """Space-separated columns; comment lines are skipped, ``missing`` becomes null, y/m/d parts a date."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    data = lines.where((F.col("line") != "") & ~F.col("line").startswith(comment))
    parts = data.select(F.split("line", r"\s+").alias("p"))
    cols = [F.get("p", F.lit(i)).try_cast(types[n]).alias(n) for i, n in enumerate(names)]
    typed = parts.select(*cols)
    for name in names:
        if types[name] == "double":
            typed = typed.withColumn(name, F.nullif(F.col(name), F.lit(missing)))
    if {"year", "month", "day"} <= set(names):
        typed = typed.withColumn("date", F.make_date("year", "month", "day"))
    return typed


def html_links(html: Column) -> tuple[Column, Column]:
    """Arrays of hrefs and anchor texts of a page."""
    pattern = F.lit(r'<a href="([^"]*)">([^<]*)</a>')
    return F.regexp_extract_all(html, pattern, F.lit(1)), F.regexp_extract_all(html, pattern, F.lit(2))


def scan_html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per link: key, position, href and anchor text."""
    hrefs, texts = html_links(F.col(html))
    zipped = F.arrays_zip(hrefs.alias("href"), texts.alias("text"))
    return pages.select(key, F.posexplode(zipped).alias("position", "link")).select(
        key, "position", "link.href", F.col("link.text").alias("anchor")
    )
