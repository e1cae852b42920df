"""Null keys, total losses, fractions, unlisted values and other cases the tables do not hold."""

from __future__ import annotations

import math
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feathergrid.ml import evaluate as E
from feathergrid.ml import models as M
from feathergrid.operators import aggs as A
from feathergrid.operators import joins as J
from feathergrid.operators import regress as D
from feathergrid.operators import rolling as RO
from feathergrid.operators import series as S
from feathergrid.plans.windows import rolling_families
from feathergrid.sources import writers


def test_asof_join_does_not_match_null_keys(spark):
    left = spark.createDataFrame([(1, "a", 100), (2, None, 100)], "id int, key string, t long")
    right = spark.createDataFrame([("a", 90, 1), (None, 90, 2)], "key string, at long, no int")
    once = {r["id"]: r["match"] for r in J.asof_join(left, right, ["key"], "t", "at", "no", 0, 60).collect()}
    assert once[1]["no"] == 1 and once[2] is None
    assert [r["id"] for r in J.asof_join_all_ties(left, right, ["key"], "t", "at", "no", 0, 60).collect()] == [1]


def test_cumulative_return_through_total_loss_and_negative_growth(spark):
    rows = [("a", 1, 0.1), ("a", 2, -1.0), ("a", 3, 0.5), ("b", 1, None), ("b", 2, -3.0), ("b", 3, 0.5), ("b", 4, -2.0)]
    df = spark.createDataFrame(rows, "k string, day int, r double")
    got = {}
    for r in df.withColumn("c", S.cumulative_return("r", S.along(["k"], ["day"]))).orderBy("k", "day").collect():
        got.setdefault(r["k"], []).append(r["c"])
    assert got["a"] == pytest.approx([0.1, -1.0, -1.0])
    assert got["b"] == pytest.approx([0.0, -3.0, -4.0, 2.0])


def test_rolling_sums_of_decimals_and_fractions_are_exact(spark):
    rows = [("a", 10, 0.5, Decimal("0.50")), ("a", 20, 0.75, Decimal("0.75")), (None, 20, 1.0, Decimal("0.25")), ("a", None, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y decimal(8,2)")
    frames = {"w": (-60, 0)}
    got = RO.with_rolling(df, ["k"], "t", {"y": F.col("y"), "x": F.col("x")}, frames).orderBy("k", "t").collect()
    assert [r["y_w"] for r in got] == [Decimal("0.25"), None, Decimal("0.50"), Decimal("1.25")]  # the null key is a key
    assert [r["x_w"] for r in got] == [1.0, None, 0.5, 1.25]


def test_rolling_sums_of_fractions_come_back_to_zero(spark):
    """Large and tiny values enter and leave; a running total of doubles would keep their rounding."""
    rng = random.Random(2)
    values = [(i, i * 10, rng.choice([1e15, -1e15, 0.1, -0.3, 1e-9, 123456.789])) for i in range(400)]
    df = spark.createDataFrame(values, "id int, t long, x double").withColumn("_row", F.lit(1)).withColumn("k", F.lit("h"))
    for r in RO.with_rolling(df, ["k"], "t", {"x": F.col("x")}, {"w": (-45, -5)}, block_seconds=100).collect():
        inside = [v for _, t, v in values if r["t"] - 45 <= t <= r["t"] - 5]
        assert r["x_w"] == pytest.approx(math.fsum(inside), rel=1e-15, abs=1e-14)


def test_rolling_families_need_one_exchange_per_key(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rolling_families(spark, sf_dir, RO.leaky_frame)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 1 and plan.count("Window [") == 4  # the join looks up the hub status
        text = rolling_families(spark, sf_dir, RO.leaky_frame)._jdf.queryExecution().executedPlan().toString()
        own = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_block" in line]
        assert len(own) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_verified_checkpoint_with_null_category(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "c string, x int")
    back, counts = writers.checkpoint_verified(df, "c")
    assert {(r["c"], r["rows_before"], r["rows_after"]) for r in counts.collect()} == {(None, 2, 2), ("a", 1, 1)}
    assert back.count() == 3
    unstable = df.withColumn("c", F.udf(lambda: uuid.uuid4().hex).asNondeterministic()())
    with pytest.raises(ValueError, match="differ"):
        writers.checkpoint_verified(unstable, "c")


def test_unlisted_values_are_counted(spark):
    df = spark.createDataFrame([(1, "A"), (1, "Z"), (1, None), (2, "A")], "r int, c string")
    assert {tuple(r) for r in A.crosstab(df, "r", "c", ["A", "B"]).collect()} == {(1, 1, 0, 2), (2, 1, 0, 0)}
    scored = spark.createDataFrame([("A", "A"), ("A", "Z"), ("Z", "B")], "y string, p string")
    assert {tuple(r) for r in E.confusion_matrix(scored, "y", "p", ["A", "B"]).collect()} == {("A", 1, 0, 1), ("Z", 0, 1, 0)}
    with pytest.raises(Exception, match="not listed: 3"):
        D.factor_dummies(spark.createDataFrame([(1,), (3,)], "f int"), "f", [1, 2], "f_").collect()


@pytest.mark.parametrize(("t", "df", "p"), [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.959966, 10**7, 0.05), (0.0, 5, 1.0), (1.0, 2, 0.4226497)])
def test_student_tails(t, df, p):
    assert A.student_tails(t, df) == pytest.approx(p, abs=2e-6)
    assert A.student_tails(-t, df) == A.student_tails(t, df)


def test_correlation_p_value_equals_regression(spark):
    rows = [(float(i), float((i * 7919) % 13 + 0.2 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = A.corr_test(df, "x", "y").first()
    table = {r["term"]: r for r in D.ols_summary(df, "y", ["x"])[0].collect()}
    assert got["p"] == pytest.approx(table["x"]["p"], rel=1e-6)


def test_bootstrap_resamples_rows_not_trials(spark):
    """With trials of a row all alike, drawing rows gives a wider interval than drawing trials."""
    together = [(float(i % 2), 20 * (i % 3 == 0), 20) for i in range(30)]
    apart = [(x, int(k < won), 1) for x, won, n in together for k in range(n)]
    widths = []
    for rows in (together, apart):
        df = spark.createDataFrame(rows, "x double, won int, n int")
        one = D.bootstrap_ci(df, "won", "n", "x", [1.0], replicates=200).first()
        assert one["replicates"] == 200
        widths.append(one["upper"] - one["lower"])
    assert widths[0] > 2.5 * widths[1]


def test_bayes_on_words_equals_spark_ml(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer

    rows = [(i, " ".join(f"w{(i * j) % 17}{'ab'[i % 2]}" if j % 3 else "the" for j in range(1, 12)), "xyx"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows + [(60, "", "x"), (61, None, "x"), (62, "unknown words", "y")], "id int, text string, y string")
    train, test = df.where("id < 40"), df.where("id >= 40")
    got = {r["id"]: r["prediction"] for r in M.tfidf_nb(train, test, "id", "text", "y").collect()}
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), M.BETWEEN_WORDS), lambda w: F.length(w) >= 2)
    stages = [StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc"), CountVectorizer(inputCol="words", outputCol="tf"), IDF(inputCol="tf", outputCol="w"), Normalizer(inputCol="w", outputCol="features"), NaiveBayes()]
    out = Pipeline(stages=stages).fit(train.withColumn("words", words)).transform(test.withColumn("words", words))
    assert got == {r["id"]: "xy"[int(r["prediction"])] for r in out.collect()}


@pytest.mark.parametrize("plain", [M.PLAIN_WORDS, 0])
def test_bayes_on_words_reads_each_text_once(spark, monkeypatch, plain):
    """With many words the common ones are joined apart from the rare ones: the predictions are the same."""
    monkeypatch.setattr(M, "PLAIN_WORDS", plain)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = [(i, " ".join(f"w{(i * j) % 17}{'ab'[i % 2]}" for j in range(1, 12)) + f" Only{i}", "xyx"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, y string")
    want = {r["id"]: r["prediction"] for r in M.tfidf_nb(df.where("id < 40"), df.where("id >= 40"), "id", "text", "y").collect()}
    assert len(want) == 20
    counted = df.withColumn("text", seen("text"))
    got = M.tfidf_nb(counted.where("id < 40"), counted.where("id >= 40"), "id", "text", "y").collect()
    assert {r["id"]: r["prediction"] for r in got} == want
    assert read.value == 60


def test_logs_of_growth_stay_precise(spark):
    df = spark.createDataFrame([("a", i, 1e-12) for i in range(1000)], "k string, day int, r double")
    last = df.withColumn("c", S.cumulative_return("r", W.partitionBy("k").orderBy("day"))).agg(F.max("c")).first()[0]
    assert last == pytest.approx(math.expm1(1000 * math.log1p(1e-12)), rel=1e-3)


def test_summary_and_medians_read_the_table_a_fixed_number_of_times(spark):
    from feathergrid.ml import prep

    df = spark.range(100).select(*[(F.col("id") * k).cast("double").alias(f"c{k}") for k in range(1, 9)])
    few, many = (A.summary_stats(df, [f"c{k}" for k in range(1, n)]) for n in (2, 9))
    exchanges = [x._jdf.queryExecution().executedPlan().toString().count("Exchange") for x in (few, many)]
    assert exchanges[0] == exchanges[1]
    row = {r["column"]: r for r in many.collect()}["c2"]
    assert (row["n"], row["mean"], row["p50"], row["max"]) == (100, 99.0, 99.0, 198.0)
    empty = A.summary_stats(df.limit(0), ["c1"]).first()
    assert (empty["column"], empty["n"], empty["mean"]) == ("c1", 0, None)
    holes = df.select(F.when(F.col("c1") > 9, F.col("c1")).alias("a"), F.lit(None).cast("double").alias("b"))
    filled = prep.impute_median(holes, ["a", "b"]).agg(F.min("a"), F.count("b")).first()
    assert tuple(filled) == (10.0, 0)


def test_newest_finished_version_is_read(spark, tmp_path):
    root = str(tmp_path / "v")
    for version, n in (("9", 1), ("10", 2)):
        writers.write_versioned(spark.range(n), root, version)
    assert writers.read_latest(spark, root).count() == 2
    (tmp_path / "v" / "version=11").mkdir()  # begun and not finished
    assert writers.read_latest(spark, root).count() == 2


def test_pagerank_steps_do_not_move_links(spark):
    from feathergrid.operators import graph as G
    from feathergrid.session import bucketed

    edges = spark.createDataFrame([(i % 7, i % 5, 1) for i in range(50)], "src int, dst int, w int")
    links, salts = G._salted(edges)
    links = bucketed(links, ["src", "salt"], "links")
    ranks = bucketed(G.nodes(edges).join(salts, "id", "left"), ["id"], "nodes").withColumn("x", F.lit(0.1))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        along = G._received(links, ranks)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # one exchange for the ranks, one for the sums; the link scan has none above it
    assert along.count("Exchange") == 2 and "SortMergeJoin" in along
