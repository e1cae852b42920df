"""Walk-forward models against fits made cycle by cycle."""

from __future__ import annotations

import os
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feathergrid.ml.walkforward import Cycles, WalkForward
from feathergrid.operators.blocks import array_sums

CYCLES = Cycles(date(2000, 1, 1), count=30, train_years=2, years_ahead=1, step=2)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    n = 3000
    out = pd.DataFrame({"who": rng.choice(["a", "b", "c", "d", None], n, p=[0.4, 0.2, 0.2, 0.1, 0.1]), "at": rng.integers(0, 60, n)})
    out["month"] = [date(2000 + int(m) // 12, int(m) % 12 + 1, 1 + int(m) % 28) for m in out["at"]]
    out["x"], out["w"] = rng.normal(5, 3, n), rng.uniform(size=n)
    out["hit"] = (out["x"] / 3 + (out["who"] == "a") + rng.normal(size=n) > 2.2).astype(int)
    out.loc[(out["who"] == "d") & (out["at"] < 40), "at"] = 59  # d is new to most windows
    out["month"] = [date(2000 + int(m) // 12, int(m) % 12 + 1, 3) for m in out["at"]]
    return out


@pytest.fixture(scope="module")
def walk(spark, frame):
    rows = spark.createDataFrame([*frame[["who", "month", "x", "w", "hit"]].itertuples(index=False, name=None), ("a", None, 1.0, 1.0, 1), ("a", date(2001, 1, 1), None, 1.0, 1)], "who string, month date, x double, w double, hit int")
    rows = rows.withColumn("m", F.lit(1)).withColumn("Y", F.lit("clash")).withColumn("entity", F.lit(0)).repartition(5)
    return WalkForward(rows, "who", "month", "hit", ["x", "w"], CYCLES)


def plain(frame, cycle):
    """Training matrix, labels, matrix to predict, its labels, of one cycle alone."""
    t = cycle * CYCLES.step
    train = frame[(frame["at"] >= t) & (frame["at"] < t + 24)]
    ahead = frame[(frame["at"] >= t + 36) & (frame["at"] < t + 38)]
    if len(train) < 30 or train["hit"].nunique() < 2:
        return None
    mean = train["hit"].mean()
    sums = train.groupby("who", dropna=False)["hit"].agg(["sum", "count"])
    code = {(None if k != k else k): (s + mean) / (n + 1) for k, s, n in sums.itertuples()}
    z = (frame[["x", "w"]] - frame[["x", "w"]].mean()) / frame[["x", "w"]].std()

    def side(part):
        codes = [code.get(None if v != v else v, mean) for v in part["who"]]
        return np.column_stack([np.ones(len(part)), z.loc[part.index], codes]), part["hit"].to_numpy()

    return *side(train), *side(ahead)


def newton(x, y, steps):
    b, penalty = np.zeros(x.shape[1]), np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
    return b


def test_cycles_know_their_months():
    for m in range(CYCLES.first - 30, CYCLES.last + 30):
        holds = [c for c in range(CYCLES.count) if 0 <= m - CYCLES.first - c * CYCLES.step < 24]
        a, b = CYCLES.trained_on(m)
        assert list(range(a, b)) == holds
    with pytest.raises(ValueError):
        Cycles(date(2000, 1, 1), step=0)


def test_cycle_table(spark):
    row = CYCLES.table(spark).where("cycle = 5").first()
    assert tuple(row)[1:] == (date(2000, 11, 1), date(2002, 11, 1), date(2003, 11, 1), date(2004, 1, 1))


def test_linear_equals_fits_one_by_one(walk, frame):
    penalty = np.diag([0.0, 1.0, 1.0, 1.0])
    coef, fitted = walk.linear(), 0
    for c in range(CYCLES.count):
        sides = plain(frame, c)
        if sides is None:
            assert np.isnan(coef[c]).all()
            continue
        x, y = sides[:2]
        assert np.allclose(coef[c], np.linalg.solve(x.T @ x + penalty, x.T @ y), atol=1e-7)
        fitted += 1
    assert fitted > 20


def test_logistic_and_scores_equal_fits_one_by_one(walk, frame):
    coef, losses = walk.logistic(5)
    got = {}
    for r in walk.scores(coef).collect():
        got.setdefault(r["cycle"], []).append((r["probability"], r["label"]))
    for c in range(CYCLES.count):
        sides = plain(frame, c)
        if sides is None:
            assert np.isnan(coef[c]).all() and c not in got
            continue
        x, y, ahead, labels = sides
        b = newton(x, y, 5)
        assert np.allclose(coef[c], b, atol=1e-6)
        want = sorted(zip(1 / (1 + np.exp(-ahead @ b)), labels))
        assert np.allclose(sorted(got.get(c, [])), want, atol=1e-6) if want else c not in got
        assert losses[0][c] == pytest.approx(np.log(2)) and losses[-1][c] < losses[0][c]


def test_every_step_is_one_aggregate_for_all_cycles(spark, walk):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("newton", "")
    walk.logistic(4)
    jobs = len(tracker.getJobIdsForGroup("newton"))
    spark.sparkContext.setJobGroup("none", "")
    assert jobs <= 3 * 4 + 4  # not a multiple of the cycles


def test_no_rows_no_models(spark):
    none = spark.createDataFrame([], "who string, month date, x double, hit int")
    w = WalkForward(none, "who", "month", "hit", ["x"], Cycles(date(2000, 1, 1), count=3))
    coef = w.linear()
    assert np.isnan(coef).all() and w.scores(coef).count() == 0 and np.isnan(w.logistic(2)[0]).all()
    paths = list(w.paths)
    w.drop()
    assert paths and not any(os.path.exists(p) for p in paths) and w.paths == []


def test_monthly_rows_join_the_benchmark_only(spark, sf_dir):
    from feathergrid.plans import walking

    rows = walking.monthly_rows(walking.sold(spark, sf_dir))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "lineitem" not in plan and rows.count() > 0


def test_sums_of_whole_numbers_stay_whole(spark):
    def make():
        total = np.zeros(60)

        def add(batch):
            if batch is None:
                return {0: total}
            ids = batch.column(0).to_numpy()
            total[:] += [(ids % (k + 2) == 0).sum() for k in range(60)]

        return add

    df = spark.range(0, 9650, 1, 11)
    got = array_sums(df, make)[0]
    assert got.tolist() == [-(-9650 // (k + 2)) for k in range(60)]
