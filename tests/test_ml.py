"""Splits, folds, models, evaluation and neighbours."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from feathergrid.ml import evaluate as E
from feathergrid.ml import models as M
from feathergrid.ml import neighbors as N
from feathergrid.ml import prep


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        y = 1.0 if x + 0.5 * z + rng.gauss(0, 0.5) > 0.4 else 0.0
        rows.append((i, x, None if i % 50 == 0 else z, y, 2015 + i % 4))
    return spark.createDataFrame(rows, "id long, x double, z double, y double, yr int").cache()


def test_stratified_split_shares_are_exact(labelled):
    out = prep.stratified_split(labelled, "y", ["id"], 42, {"train": 0.8, "val": 0.1, "test": 0.1})
    for label in (0.0, 1.0):
        n = labelled.where(F.col("y") == label).count()
        got = {r["data_type"]: r["count"] for r in out.where(F.col("y") == label).groupBy("data_type").count().collect()}
        assert abs(got["train"] - 0.8 * n) <= 1 and abs(got["val"] - 0.1 * n) <= 1 and sum(got.values()) == n


def test_oversampling_balances(labelled):
    counts = {r["y"]: r["count"] for r in prep.oversample_minority(labelled, "y", ["id"], 3).groupBy("y").count().collect()}
    assert counts[0.0] == labelled.where("y = 0").count()
    assert counts[1.0] == pytest.approx(counts[0.0], rel=0.1)
    drawn = {r["y"]: r["count"] for r in prep.oversample_poisson(labelled, "y", 3).groupBy("y").count().collect()}
    assert drawn[1.0] == pytest.approx(drawn[0.0], rel=0.2)


def test_time_series_folds_only_look_back(labelled):
    folded = prep.fold_column(labelled, F.col("yr"), [2015, 2016, 2017, 2018])
    cv = prep.TimeSeriesCrossValidator(foldCol="fold", numFolds=3)
    for train, validation in cv._kFold(folded):
        assert train.agg(F.max("fold")).first()[0] < validation.agg(F.min("fold")).first()[0]
    with pytest.raises(ValueError, match="empty"):
        cv._kFold(folded.where("fold <> 2"))
    with pytest.raises(ValueError, match="fold numbers"):
        prep.TimeSeriesCrossValidator(foldCol="fold", numFolds=2)._kFold(folded)


def test_time_series_cross_validation_fits(labelled):
    folded = prep.fold_column(labelled, F.col("yr"), [2015, 2016, 2017, 2018])
    known = folded.where("fold <= 2")
    model, table = M.timeseries_cv(known, "logistic", "y", "fold", 2, [], ["x", "z"], {"regParam": [0.01]})
    assert table.first()["mean_auc"] > 0.8
    assert M.scores(model, labelled, "y", "best").first()["accuracy"] > 0.7


@pytest.mark.parametrize("kind, params", [("logistic", {"regParam": 0.01}), ("svm", {"regParam": 0.1, "maxIter": 50}), ("boosted", {"maxDepth": 2, "maxIter": 5})])
def test_equal_rows_are_fitted_once(spark, monkeypatch, kind, params):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), float(rng.randint(0, 9)), None if rng.random() < 0.1 else rng.randint(0, 4) / 4) for _ in range(2000)]
    rows = [(c, x, z, float(x + 4 * (z or 0) + (c == "a") + rng.gauss(0, 2) > 6)) for c, x, z in rows]
    df = spark.createDataFrame(rows, "c string, x double, z double, y double")
    ready, fitted = M.classifier, []

    def watched(*args, **kwargs):
        made = ready(*args, **kwargs)
        fit = made.fit
        made.fit = lambda d: fitted.append(d.count()) or fit(d)
        return made

    monkeypatch.setattr(M, "classifier", watched)
    got = M.grid_scores(df, df, kind, "y", ["c"], ["x", "z"], [params]).first()
    model = M.fit(df, kind, "y", ["c"], ["x", "z"], **params)
    want = M.scores(model, df, "y", "all rows").first()
    assert fitted[0] < 400 and got["n"] == 2000
    assert list(got)[2:] == pytest.approx(list(want)[2:], abs=2e-3)


def test_walk_forward_has_a_gap_for_labels(spark):
    months = spark.sql("select explode(sequence(date'2000-01-01', date'2010-12-01', interval 1 month)) as m")
    first, *_, last = prep.walk_forward_windows(months, "m", cycles=12, train_years=3).orderBy("cycle").collect()
    assert [str(v) for v in first[1:]] == ["2000-01-01", "2003-01-01", "2004-01-01", "2004-02-01"]
    assert str(last["train_start"]) == "2000-12-01"


def test_own_gradient_descent_agrees_with_the_library(labelled):
    data = labelled.na.drop()
    weights, losses = M.logistic_gd(data, "y", ["x", "z"], steps=80, rate=4.0, reg=0.0)
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))
    vectors = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(data)
    best = LogisticRegression(labelCol="y").fit(vectors)
    assert weights == pytest.approx([best.intercept, *best.coefficients], abs=0.02)


def test_metrics_equal_spark_evaluators(labelled):
    scored = labelled.withColumn("p", F.round(F.col("x"), 1)).withColumn("prediction", F.when(F.col("x") > 0, 1.0).otherwise(0.0))
    row = E.class_metrics(scored, "y", "prediction").first()
    ev = MulticlassClassificationEvaluator(labelCol="y")
    for ours, theirs in (("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"), ("weighted_f", "f1")):
        assert row[ours] == pytest.approx(ev.evaluate(scored, {ev.metricName: theirs}))
    auc = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0).evaluate(scored)
    assert E.roc_auc(scored, "y", "p").first()["auc"] == pytest.approx(auc)
    c = E.binary_confusion(scored, "y", "prediction").first()
    assert sum(c) == labelled.count()


def test_class_never_predicted_and_null_label(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (None, 1.0)], "y double, p double")
    got = {r["label"]: (r["precision"], r["recall"], r["f"]) for r in E.label_metrics(df, "y", "p").collect()}
    assert got == {0.0: (0.5, 1.0, pytest.approx(2 / 3)), 1.0: (0.0, 0.0, 0.0)}


def test_permuted_column_keeps_its_values(labelled):
    out = E.permuted(labelled, ["id"], "x", 4)
    assert sorted(r["x"] for r in out.collect()) == sorted(r["x"] for r in labelled.collect())
    moved = out.alias("a").join(labelled.alias("b"), "id").where("a.x <> b.x").count()
    assert moved > 1000
    rule = F.when(F.col("x") > 0.4, 1.0).otherwise(0.0)
    lost = {r["feature"]: r["importance"] for r in E.permutation_importance(labelled, ["id"], ["x", "z"], "y", rule, 9).collect()}
    assert lost["x"] > 0.15 and lost["z"] == 0.0


def test_importance_shuffles_each_feature_by_two_orders(spark):
    """Not by one order and a fixed distance, which pairs neighbours of one feature with neighbours again."""
    n = 500
    df = spark.range(n).select("id", F.col("id").alias("x"), F.col("id").alias("z"), F.lit(1).alias("y"))
    digest = lambda seed, i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
    order = lambda seed: sorted(range(n), key=lambda i: digest(seed, i))
    rule = F.when((F.col("x") * 7 + F.col("z") * 3) % 101 < 60, 1).otherwise(0)
    hit = lambda x, z: (x * 7 + z * 3) % 101 < 60
    base = sum(hit(i, i) for i in range(n)) / n
    want = {
        "x": base - sum(hit(other, i) for i, other in zip(order(11), order(12))) / n,
        "z": base - sum(hit(i, other) for i, other in zip(order(13), order(14))) / n,
    }
    got = {r["feature"]: r["importance"] for r in E.permutation_importance(df, ["id"], ["x", "z"], "y", rule, 11).collect()}
    assert got == pytest.approx(want) and want["x"] != 0


@pytest.mark.parametrize("piece_rows", [4096, 16])
def test_knn_equals_brute_force(spark, piece_rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6)) * 4
    v = np.concatenate([centres[i % 4] + rng.normal(size=(1, 6)) for i in range(240)]).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    train, test = df.where("id < 160"), df.where("id >= 160")
    got = {}
    for r in N.knn(train, test, "id", "v", "label", 7, pivots=5, piece_rows=piece_rows).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    x = v.astype(np.float64)
    for i in range(160, 240):
        d = np.sqrt(((x[:160] - x[i]) ** 2).sum(1))
        assert got[i] == set(np.argsort(d, kind="stable")[:7].tolist())


def test_knn_with_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [1.0, 1.0], 1)], "id long, v array<float>, label int")
    assert N.knn(df, df, "id", "v", "label", 5, pivots=2).count() == 4


def test_mixture_density_is_the_gaussian_density(spark):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(0)
    rows = [([float(a), float(b)],) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a array<double>").select(array_to_vector("a").alias("v"))
    model = GaussianMixture(k=2, featuresCol="v", seed=1).fit(df)
    got = df.limit(1).select("v", M.mixture_log_density(model, "v").alias("l")).first()
    want = 0.0
    for w, g in zip(model.weights, model.gaussians):
        d, cov = got["v"].toArray() - g.mean.toArray(), g.cov.toArray()
        want += w * math.exp(-0.5 * d @ np.linalg.inv(cov) @ d) / (2 * math.pi * math.sqrt(np.linalg.det(cov)))
    assert got["l"] == pytest.approx(math.log(want))


def test_random_search_and_grid_are_seeded():
    assert M.random_search(M.GRIDS["logistic"], 3) == M.random_search(M.GRIDS["logistic"], 3)
    assert len(M.random_search(M.GRIDS["svm"], 99)) == 6


def test_imputed_median_and_target_encoding(labelled, spark):
    filled = prep.impute_median(labelled, ["z"])
    median = labelled.agg(F.percentile("z", 0.5)).first()[0]
    assert filled.where("id = 50").first()["z"] == pytest.approx(median)
    train = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "k string, y int")
    seen = train.select("k").distinct().unionByName(spark.createDataFrame([("c",)], "k string"))
    out = {r["k"]: r["k_enc"] for r in prep.target_encode(train, seen, "k", "y", 1.0).collect()}
    assert out == pytest.approx({"a": (2 + 2 / 3) / 3, "b": (2 / 3) / 2, "c": 2 / 3})


def test_pipeline_indexes_unseen_labels(spark):
    train = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 1.0), ("b", None, 1.0)], "c string, x double, y double")
    model = Pipeline(stages=M.feature_stages(["c"], ["x"])).fit(train)
    out = model.transform(spark.createDataFrame([("zzz", 1.0, 0.0)], "c string, x double, y double")).first()
    assert out["c_idx"] == 2.0


def test_descent_reads_equal_rows_once(spark, monkeypatch):
    df = spark.range(4000).selectExpr("cast(id % 2 as double) as x", "cast(id % 5 + id % 2 > 2 as double) as y")
    sizes, sums = [], M.array_sums
    monkeypatch.setattr(M, "array_sums", lambda rows, make: sizes.append(rows.count()) or sums(rows, make))
    weights, losses = M.logistic_gd(df, "y", ["x"], steps=2)
    assert sizes == [4, 4, 4]
    odd = df.limit(10)  # one of each ten rows
    assert M.logistic_gd(odd, "y", ["x"], steps=2, reg=0.1 / 400)[1] == pytest.approx(losses, abs=1e-12)
