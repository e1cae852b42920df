"""Projections and filters that look at the data or at names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: minimum price and market capitalisation of the universe
MIN_PRICE, MIN_MARKET_CAP = 5, 300
# fixed values: bodies of withdrawn posts
WITHDRAWN = ["[removed]", "[deleted]"]


def keep_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def rename_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def sparse_columns(df: DataFrame, threshold: float = 0.96) -> list[str]:
    """Columns with more than ``threshold`` nulls, from one pass that returns one row."""
    row = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    ).first()
    return [c for c in df.columns if row[c] > threshold * row["_n"]]


def drop_sparse_columns(df: DataFrame, threshold: float = 0.96) -> DataFrame:
    return df.drop(*sparse_columns(df, threshold))


def drop_all_zero_columns(df: DataFrame) -> DataFrame:
    """Drop numeric columns that are 0 in every row (null counts as not zero)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    row = df.agg(*[F.max(F.coalesce(F.abs(c).cast("double"), F.lit(1.0))).alias(c) for c in numeric]).first()
    return df.drop(*[c for c in numeric if row[c] == 0])


def time_range_filter(df: DataFrame, t: str, start: Column, stop: Column) -> DataFrame:
    """Half-open range; both bounds reach the parquet scan."""
    return df.where((F.col(t) >= start) & (F.col(t) < stop))


def drop_na(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset else None)


def universe_filter(
    df: DataFrame,
    price: str,
    market_cap: str,
    min_price: float = MIN_PRICE,
    min_cap: float = MIN_MARKET_CAP,
    ticker: str | None = None,
    tickers: Sequence | None = None,
) -> DataFrame:
    keep = (F.col(price) >= min_price) & (F.col(market_cap) >= min_cap)
    if tickers:
        keep = keep & F.col(ticker).isin(list(tickers))
    return df.where(keep)


def text_validity_filter(df: DataFrame, body: str, title: str, out: str = "text") -> DataFrame:
    """Drop withdrawn bodies; an empty or missing body is replaced by the title."""
    text = F.coalesce(F.nullif(F.col(body), F.lit("")), F.col(title))
    return df.where(F.col(body).isNull() | ~F.col(body).isin(WITHDRAWN)).withColumn(out, text)
