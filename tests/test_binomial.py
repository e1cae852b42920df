"""Binomial fits and their bootstrap against numpy, and the clustered sandwich with leverage."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feathergrid.operators import binomial as B
from feathergrid.operators import regress as D


def newton(design, won, n, offset=0.0, steps=40):
    b = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(design @ b + offset)))
        h = (design * (n * p * (1 - p))[:, None]).T @ design
        b = b + np.linalg.solve(h, design.T @ (won - n * p))
    return b, np.linalg.inv(h)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(1)
    x, z, n = rng.normal(3, 2, 400), rng.uniform(size=400), rng.integers(1, 8, 400)
    won = rng.binomial(n, 1 / (1 + np.exp(-(0.4 * x - 1.5 + z))))
    return x, z, n, won


def frame(spark, sample):
    rows = [(float(a), float(b), int(n), int(w), i) for i, (a, b, n, w) in enumerate(zip(*sample))]
    rows += [(None, 1.0, 1, 1, 900), (1.0, 1.0, None, 1, 901), (1.0, 1.0, 0, 0, 902)]
    return spark.createDataFrame(rows, "x double, z double, n int, won int, id long").repartition(6)


def test_fit_equals_numpy_with_offset_and_interaction(spark, sample):
    x, z, n, won = sample
    df = frame(spark, sample).withColumn("xz", F.col("x") * F.col("z"))
    b, inverse = newton(np.column_stack([np.ones(400), x, z, x * z]), won, n)
    table, fit = B.binomial_glm(df, "won", "n", ["x", "z", "xz"])
    assert fit.coef == pytest.approx(b, abs=1e-7) and fit.se == pytest.approx(np.sqrt(np.diag(inverse)), rel=1e-6)
    row = table.where("term = 'x'").first()
    assert row["z"] == pytest.approx(b[1] / fit.se[1]) and row["p"] == pytest.approx(math.erfc(abs(row["z"]) / 2**0.5))
    shifted = B.fit_binomial(df, "won", "n", ["x"], offset="z")
    assert shifted.coef == pytest.approx(newton(np.column_stack([np.ones(400), x]), won, n, z)[0], abs=1e-7)


def test_a_sample_of_one_outcome_is_refused(spark):
    with pytest.raises(ValueError):
        B.fit_binomial(spark.createDataFrame([(1.0, 2, 2)], "x double, won int, n int"), "won", "n", ["x"])


def test_weights_are_poisson_and_belong_to_the_row():
    lanes = B._lanes(400, 7)
    w = B.row_weights(np.arange(3000) * 10 + 3, lanes)
    for k in range(6):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=2e-3)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15
    assert (B.row_weights(np.array([33, 3]), lanes) == w[[3, 0]]).all()


def test_bootstrap_equals_refits_one_by_one(spark, sample):
    x, _, n, won = sample
    got = B.bootstrap_fits(frame(spark, sample), "won", "n", "x", replicates=40, key="id")
    w = B.row_weights(np.arange(400), B._lanes(40, 7))
    for r in range(40):
        want = newton(np.column_stack([np.ones(400), x]), won * w[:, r], n * w[:, r])[0]
        assert got[:, r] == pytest.approx(want, abs=1e-6)
    again = B.bootstrap_fits(frame(spark, sample).repartition(3), "won", "n", "x", replicates=40, key="id")
    assert again == pytest.approx(got, abs=1e-8)


def test_bootstrap_spread_is_the_standard_error(spark, sample):
    df = frame(spark, sample)
    se = B.fit_binomial(df, "won", "n", ["x"]).se[1]
    for parametric in (False, True):
        slopes = B.bootstrap_fits(df, "won", "n", "x", replicates=500, parametric=parametric, key="id")[1]
        assert slopes.std() == pytest.approx(se, rel=0.2)


def test_clusters_with_leverage(spark):
    rng = np.random.default_rng(8)
    g, x, v = np.repeat(np.arange(12), 5), rng.normal(size=60), rng.normal(size=60) ** 2
    y = 2 * x - v + g + rng.normal(size=60) * (1 + abs(x))
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(g, x, v, y)], "g int, x double, v double, y double")
    fit, within = D.fixed_effects(df, "g", "y", ["x", "v"])
    inner = np.column_stack([x, v])
    inner = inner - np.stack([inner[g == k].mean(0) for k in g])
    z = y - np.array([y[g == k].mean() for k in g])
    bread = np.linalg.inv(inner.T @ inner)
    e = (z - inner @ bread @ inner.T @ z) / (1 - np.einsum("ij,jk,ik->i", inner, bread, inner))
    scores = np.stack([inner[g == k].T @ e[g == k] for k in range(12)])
    want = np.sqrt(np.diag(bread @ scores.T @ scores @ bread))
    got = {r["term"]: r["std_error"] for r in D.clustered_se(within, fit, "g", "y", leverage=True).collect()}
    assert [got["x"], got["v"]] == pytest.approx(want, rel=1e-9)
    assert {r["term"]: r["std_error"] for r in D.clustered_se(within, fit, "g", "y").collect()}["x"] < got["x"]


def test_large_samples_need_one_pass_for_all_replicates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 4, 200_000)
    won = (rng.random(len(x)) < 1 / (1 + np.exp(1.0 - 0.5 * x))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": x, "won": won, "n": 1.0}))
    passes, sums = [], B.array_sums
    monkeypatch.setattr(B, "array_sums", lambda rows, make: passes.append(1) or sums(rows, make))
    B.fit_binomial(df, "won", "n", ["x"])
    full, passes[:] = len(passes), []
    got = B.bootstrap_fits(df, "won", "n", "x", replicates=20, key="id")
    assert len(passes) - full == 1
    weights = B.row_weights(np.arange(len(x)), B._lanes(20, 7))
    for r in range(3):
        design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
        for _ in range(12):
            p = 1 / (1 + np.exp(-design @ beta))
            w = weights[:, r]
            beta = beta + np.linalg.solve(design.T @ ((w * p * (1 - p))[:, None] * design), design.T @ (w * (won - p)))
        assert got[:, r] == pytest.approx(beta, abs=1e-8)


def test_row_weights_follow_the_hash_and_its_edges():
    keys, lanes = np.array([0, 1, B.PRIME, 2**62 + 11, -5]), B._lanes(4000, 7)
    z = B.hashed(B.hashed(keys % B.PRIME)[:, None] ^ lanes)
    assert (B.row_weights(keys, lanes) == sum((z >= edge).astype(float) for edge in B.POISSON)).all()
