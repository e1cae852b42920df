"""Column functions on the edge cases of the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feathergrid.functions import columns as C
from feathergrid.functions import text as X
from feathergrid.functions import timefns as TF
from feathergrid.operators import aggs as A
from feathergrid.operators import project as P


def values(df, col):
    return [r[col] for r in df.collect()]


def test_local_to_utc_gap_overlap_and_normal(spark):
    rows = [
        ("2015-02-10 1729", "America/New_York", "2015-02-10 22:29:00"),
        ("2015-03-08 0230", "America/New_York", None),
        ("2015-11-01 0130", "America/New_York", None),
        ("2015-11-01 0330", "America/New_York", "2015-11-01 08:30:00"),
        ("2015-07-01 0000", "America/Phoenix", "2015-07-01 07:00:00"),
        ("bad", "America/New_York", None),
        (None, "America/New_York", None),
    ]
    df = spark.createDataFrame(rows, "t string, z string, want string")
    got = df.withColumn("got", F.date_format(TF.local_to_utc(F.col("t"), F.col("z")), "yyyy-MM-dd HH:mm:ss"))
    assert all(r["got"] == r["want"] for r in got.collect())


def test_hhmm_and_part_of_day(spark):
    df = spark.createDataFrame([("5",), ("0005",), ("45",), ("125",), ("1729",), ("2400",), ("x",), (None,)], "t string")
    out = df.select(C.hhmm_to_hour(F.col("t")).alias("h"))
    assert values(out, "h") == [0, 0, 0, 1, 17, 0, None, None]
    hours = spark.range(24).select(C.part_of_day(F.col("id")).alias("p"))
    assert values(hours, "p") == ["Night"] * 5 + ["Morning"] * 7 + ["Afternoon"] * 5 + ["Evening"] * 4 + ["Night"] * 3


def test_clip_keeps_null_and_ratio_edges(spark):
    df = spark.createDataFrame([(None, 1.0), (9.0, 0.0), (-9.0, 0.0), (0.0, 0.0), (1.0, -2.0)], "a double, b double")
    out = df.select(
        C.clip(F.col("a"), -1.0, 1.0).alias("c"),
        C.clamped_ratio(F.col("a"), F.col("b")).alias("r"),
        C.abs_ratio_of_base(F.col("a"), F.col("b")).alias("s"),
        C.abs_ratio_of_positive_base(F.col("a"), F.col("b")).alias("p"),
    ).collect()
    assert [r["c"] for r in out] == [None, 1.0, -1.0, 0.0, 1.0]
    assert [r["r"] for r in out] == [0.0, 5.0, -5.0, 0.0, -0.5]
    assert [r["s"] for r in out] == [0.0, 5.0, 5.0, 0.0, 0.5]
    assert [r["p"] for r in out] == [0.0, 0.0, 0.0, 0.0, 0.0]


def test_weather_thresholds_and_quality(spark):
    packed = [
        ("A, US", "100,1,N,0152,1", "01000,1,M,N", "010000,1,N,5", "+0100,1", "+0090,1", "10132,1"),
        ("", "100,1,N,0010,1", "01000,1,M,N", "010000,1,N,5", "+0100,1", "-0090,1", "10066,1"),
        ("B, CA", "100,1,N,0010,1", "01000,1,M,N", "010000,1,N,5", "+0100,1", "+0090,1", "10132,1"),
        ("C, US", "999,1,N,0010,1", "01000,1,M,N", "010000,1,N,5", "+0100,1", "+0090,1", "10132,1"),
        ("D, US", "100,2,N,0010,1", "01000,1,M,N", "010000,1,N,5", "+0100,1", "+0090,1", "10132,1"),
        ("E, US", "100,1,N,0010,1", "01000,1,M,N", "010000,1,N,5", "+9999,9", "+0090,1", "10132,1"),
    ]
    df = spark.createDataFrame(packed, "NAME string, WND string, CIG string, VIS string, TMP string, DEW string, SLP string")
    names = [n for group in C.PACKED_LAYOUT.values() for n in group if n in C.MISSING_READING or n.endswith("quality_code")]
    typed = C.unpack_composite(df, types={n: "double" for n in names})
    kept = C.quality_filter(typed)
    assert values(kept, "NAME") == ["A, US", ""]
    flag = C.bad_weather_flag(
        F.col("DEW_dew_point_temperature") / 10,
        F.col("TMP_air_temperature") / 10,
        F.col("WND_speed") / 10,
        F.col("SLP_sea_level_pressure") / 10,
        F.col("VIS_distance_dimension"),
    )
    assert values(kept.select(flag.alias("f")), "f") == [1, 0]


def test_cast_tolerant_gives_null(spark):
    df = spark.createDataFrame([("abc",), ("1.5",), (None,)], "a string")
    assert values(C.cast_tolerant(df, {"a": "float"}), "a") == [None, 1.5, None]


def test_token_recode(spark):
    df = spark.createDataFrame([("NR",), ("<.01",), ("0.35",), (None,)], "a string")
    assert values(df.select(F.round(C.token_recode(F.col("a")), 6).alias("p")), "p") == [None, 0.1, 35.0, None]


def test_slang_example_and_alternation_order(spark):
    text = "brb some sample text I lov u. I need some $$ for 2mw."
    df = spark.createDataFrame([(text,), ("btw u know", ), (None,), ("brbx xbrb",)], "t string")
    out = values(df.select(X.dictionary_replace(F.col("t"), X.SLANG).alias("o")), "o")
    assert out[0] == "be right back some sample text I love you. I need some money for tomorrow."
    # 'btw' stands before 'btw u' in the dictionary, so it wins and 'u' follows on its own
    assert out[1] == "by the way you know"
    assert out[2] is None
    assert out[3] == "brbx xbrb"


def test_text_normalize(spark):
    df = spark.createDataFrame([("See r/News by u/Bob now &amp; it’s  OK \n",)], "t string")
    assert values(df.select(X.text_normalize(F.col("t")).alias("o")), "o") == ["see the subcategory of: news by now & ; it's ok"]


def test_drop_sparse_and_zero_columns(spark):
    rows = [(i, None if i < 97 else 1, 0, None if i % 2 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, rare int, zero int, gaps int")
    assert P.drop_sparse_columns(df).columns == ["id", "zero", "gaps"]
    assert P.drop_all_zero_columns(df).columns == ["id", "rare", "gaps"]


def test_text_validity(spark):
    rows = [("a", "[removed]"), ("b", "[deleted]"), ("c", ""), ("d", None), ("e", "body")]
    df = spark.createDataFrame(rows, "title string, selftext string")
    assert values(P.text_validity_filter(df, "selftext", "title"), "text") == ["c", "d", "body"]


def test_utility_edges(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 0), (2, 1.0, 1.0, 0)], "d int, w double, r double, a int")
    assert A.utility_score(df, "d", "w", "r", "a").first()["utility"] == 0.0
    good = spark.createDataFrame([(i, 1.0, 1.0, 1) for i in range(100)], "d int, w double, r double, a int")
    assert A.utility_score(good, "d", "w", "r", "a").first()["utility"] == 600.0
    bad = spark.createDataFrame([(i, 1.0, -1.0, 1) for i in range(9)], "d int, w double, r double, a int")
    assert A.utility_score(bad, "d", "w", "r", "a").first()["utility"] == 0.0


def test_map_and_multi_hot(spark):
    df = spark.createDataFrame([(["Person", "TBD"],)], "tags array<string>")
    vocab = ["Organization", "Person", "Product", "Place", "Other", "TBD"]
    assert values(df.select(C.multi_hot(F.col("tags"), vocab).alias("h")), "h") == [[0, 1, 0, 0, 0, 1]]
