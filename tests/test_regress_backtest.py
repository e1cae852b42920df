"""Regression tables against numpy, back-test rules on small frames, sinks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from feathergrid.operators import backtest as B
from feathergrid.operators import regress as D
from feathergrid.session import scratch_path
from feathergrid.sources import readers, writers


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(40):
        level = rng.normal() * 3
        for y in range(8):
            x1, x2 = rng.normal() + level / 3, rng.normal()
            rows.append((s, 2000 + y, float(level + 2 * x1 - x2 + 0.3 * y + rng.normal()), float(x1), float(x2)))
    return spark.createDataFrame(rows, "state int, year int, y double, x1 double, x2 double").cache()


def design(panel, cols):
    pdf = panel.toPandas()
    return np.column_stack([np.ones(len(pdf)), *[pdf[c] for c in cols]]), pdf["y"].to_numpy(), pdf


def test_ols_equals_numpy_and_spark(panel):
    x, y, _ = design(panel, ["x1", "x2"])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    fit = D.ols(panel, "y", ["x1", "x2"])
    assert fit.coef == pytest.approx(beta)
    e = y - x @ beta
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(y) - 3))
    assert fit.se == pytest.approx(se)
    table, stats = D.ols_summary(panel, "y", ["x1", "x2"])
    rows = {r["term"]: r for r in table.collect()}
    assert rows["x1"]["std_error"] == pytest.approx(se[1])
    assert stats["r2"] == pytest.approx(fit.r2)
    h = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    bread = np.linalg.inv(x.T @ x)
    hc3 = bread @ (x.T * (e / (1 - h)) ** 2) @ x @ bread
    got = [r["std_error"] for r in D.hc3_se(panel, fit, "y").collect()]
    assert got == pytest.approx(np.sqrt(np.diag(hc3))[1:])


def test_fixed_effects_equal_dummy_regression(panel):
    years = list(range(2000, 2008))
    fit, within = D.fixed_effects(panel, "state", "y", ["x1", "x2"], "year", years)
    x, y, pdf = design(panel, ["x1", "x2"])
    dummies = [(pdf["state"] == s).astype(float) for s in range(1, 40)] + [(pdf["year"] == v).astype(float) for v in years[1:]]
    full = np.column_stack([x, *dummies])
    beta, *_ = np.linalg.lstsq(full, y, rcond=None)
    assert fit.coef[1:3] == pytest.approx(beta[1:3])
    e = y - full @ beta
    se = np.sqrt(np.diag(np.linalg.inv(full.T @ full)) * (e @ e) / (len(y) - full.shape[1]))
    assert fit.se[1:3] == pytest.approx(se[1:3])
    assert D.clustered_se(within, fit, "state", "y").count() == 9


def test_vif_and_chi_square(panel):
    got = {r["term"]: r["vif"] for r in D.vif(panel, ["x1", "x2"]).collect()}
    r = panel.corr("x1", "x2")
    assert got["x1"] == pytest.approx(1 / (1 - r * r))
    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05)):
        assert D.chi2_tail(x, df) == pytest.approx(p, abs=1e-6)


# temperature and failures of six rings: the well-known slope on temperature alone is about -0.116 per degree
CHALLENGER = [
    (66, 0), (70, 1), (69, 0), (68, 0), (67, 0), (72, 0), (73, 0), (70, 0), (57, 1), (63, 1), (70, 1), (78, 0),
    (67, 0), (53, 2), (67, 0), (75, 0), (70, 0), (81, 0), (76, 0), (79, 0), (75, 2), (76, 0), (58, 1),
]


def test_binomial_glm_and_intervals(spark):
    df = spark.createDataFrame([(float(t), o, 6) for t, o in CHALLENGER], "Temp double, fails int, Number int")
    table, model = D.binomial_glm(df, "fails", "Number", ["Temp"])
    assert model.coefficients[0] == pytest.approx(-0.1156, abs=0.003)
    assert table.count() == 2
    low, mid = D.wald_interval(df, "fails", "Number", "Temp", [31.0, 72.0]).orderBy("x").collect()
    assert low["lower"] < low["probability"] < low["upper"] and mid["upper"] < low["upper"]
    test = D.likelihood_ratio(df.withColumn("t2", F.col("Temp") ** 2), "fails", "Number", ["Temp"], ["Temp", "t2"]).first()
    assert test["deviance"] >= 0 and 0 <= test["p"] <= 1
    for parametric in (False, True):
        rows = D.bootstrap_ci(df, "fails", "Number", "Temp", [31.0, 72.0], replicates=60, parametric=parametric).orderBy("x").collect()
        assert [r["replicates"] for r in rows] == [60, 60]
        assert rows[0]["lower"] < low["probability"] < rows[0]["upper"]


def test_decomposition_recovers_trend_and_season(spark):
    rows = [(0, f"20{10 + i // 12}-{i % 12 + 1:02d}-01", 5.0 + 0.5 * i + (3.0 if i % 12 == 0 else 0.0)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, d string, y double").withColumn("d", F.to_date("d"))
    out = D.classical_decompose(df, ["k"], "d", "y").where("trend is not null")
    assert out.agg(F.max(F.abs("remainder"))).first()[0] == pytest.approx(0.0, abs=1e-9)
    fits, table = D.trend_season_regression(df, ["k"], "d", "y")
    sse = {r["model"]: r["sse"] for r in table.collect()}
    assert sse["seasonal"] == pytest.approx(0.0, abs=1e-6) and sse["linear"] > 1
    ahead = D.trend_forecast(df, "d", "y", fits["linear"], 3).collect()
    assert [str(r["d"]) for r in ahead] == ["2015-01-01", "2015-02-01", "2015-03-01"]


def test_backtest_on_a_small_book(spark):
    days = spark.sql("select explode(sequence(date'2019-12-01', date'2021-03-31')) as datadate")
    rates = spark.createDataFrame([("up", 1.001), ("flat", 1.0), ("down", 0.999)], "tic string, r double")
    n = F.datediff("datadate", F.lit("2019-12-01"))
    prices = days.join(rates.withColumn("one", F.lit(1)), F.lit(True)).select("tic", "datadate", (100 * F.pow("r", n)).alias("price"))
    scores = spark.createDataFrame(
        [("2019-12-01", "up", 0.9), ("2019-12-01", "flat", 0.8), ("2019-12-01", "gone", 0.99), ("2020-01-01", "down", 0.7)],
        "month string, ticker string, probability double",
    ).withColumn("month", F.to_date("month"))
    picks = B.pick_top_k(scores, prices, k=1)
    assert sorted((str(r["start_date"]), r["ticker"]) for r in picks.collect()) == [("2020-01-01", "up"), ("2020-02-01", "down")]
    own = B.pick_returns(picks, prices)
    finals = {str(r["start_date"]): r["own"] for r in B.cohort_finals(own, "own").collect()}
    assert finals["2020-01-01"] == pytest.approx(1.001**365 - 1)
    assert finals["2020-02-01"] == pytest.approx(0.999**365 - 1)
    flat = prices.where("tic = 'flat'").select("datadate", "price")
    bench = B.benchmark_returns(picks.select("start_date").distinct(), flat)
    row = B.cohort_summary(own, bench).first()
    assert row["cohorts"] == 2 and row["outperform"] == 0.5
    assert row["risk"] == pytest.approx(-100 * (0.999**365 - 1)) and row["benchmark_total"] == pytest.approx(0.0)


def test_versions_and_verified_checkpoint(spark):
    root = scratch_path(spark, "versions")
    writers.write_versioned(spark.range(3), root, "1")
    writers.write_versioned(spark.range(5), root, "2")
    assert readers.scan_parquet(spark, f"{root}/version=1").count() == 3
    assert writers.read_latest(spark, root).count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_versioned(spark.range(1), root, "2")
    df = spark.range(100).withColumn("c", F.col("id") % 3)
    back, counts = writers.checkpoint_verified(df, "c")
    assert back.count() == 100
    assert counts.where("rows_before <> rows_after").count() == 0


def test_csv_in_latin1_and_whitespace_text(spark, tmp_path):
    (tmp_path / "slang.csv").write_bytes("Slang Term,Meaning,n\ncaf\xe9,coffee,1\nbrb,be right back,x\n".encode("latin-1"))
    types = {"Slang Term": "string", "Meaning": "string", "n": "int"}
    rows = readers.scan_csv_typed(spark, str(tmp_path / "slang.csv"), types, encoding="iso-8859-1").collect()
    assert [tuple(r) for r in rows] == [("café", "coffee", 1), ("brb", "be right back", None)]
    (tmp_path / "co2.txt").write_text("# head\n 1974  5 19  1974.38   333.37\n1974 5 26 1974.40 -999.99\n\n")
    types = {"year": "int", "month": "int", "day": "int", "decimal": "double", "ppm": "double"}
    rows = readers.scan_whitespace_text(spark, str(tmp_path / "co2.txt"), list(types), types, -999.99).collect()
    assert [(str(r["date"]), r["ppm"]) for r in rows] == [("1974-05-19", 333.37), ("1974-05-26", None)]


def test_approximate_distinct_counts_are_close(spark):
    from feathergrid.operators.rows import count_distinct_by

    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 3000).alias("v"))
    exact = {r["k"]: r["n"] for r in count_distinct_by(df, ["k"], {"n": "v"}).collect()}
    close = {r["k"]: r["n"] for r in count_distinct_by(df, ["k"], {"n": "v"}, error=0.02).collect()}
    assert exact == {0: 1500, 1: 1500}
    assert all(abs(close[k] - exact[k]) < 150 for k in exact)
