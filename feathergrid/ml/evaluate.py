"""Scores of labelled predictions as small tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feathergrid.operators.aggs import utility_score, with_totals
from feathergrid.operators.ordered import numbered, value_counts_running
from feathergrid.operators.rows import seeded_hash


def confusion_counts(df: DataFrame, label: str, prediction: str, times: str | None = None) -> DataFrame:
    """``(label, prediction, n)``: the one pass every other table here starts from; a row may stand for ``times`` rows."""
    n = F.sum(times).cast("long") if times else F.count(F.lit(1))
    known = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return known.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(n.alias("n"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """A row per label, a column per listed prediction and ``other`` for all else; ``confusion_counts`` has them all."""
    counts, said, n = confusion_counts(df, label, prediction), F.col("prediction"), F.col("n")
    listed = [F.coalesce(F.sum(F.when(said == c, n)), F.lit(0)).alias(str(c)) for c in classes]
    return counts.groupBy("label").agg(*listed, F.sum(F.when(said.isin(list(classes)), 0).otherwise(n)).alias("other"))


def binary_confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    n, hit = F.col("n"), F.col("label") == F.col("prediction")
    one = F.col("prediction") == 1

    def part(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    return confusion_counts(df, label, prediction).agg(
        part(hit & one).alias("tp"), part(~hit & one).alias("fp"), part(~hit & ~one).alias("fn"), part(hit & ~one).alias("tn")
    )


def label_metrics(df: DataFrame, label: str, prediction: str, times: str | None = None) -> DataFrame:
    """Precision, recall, F and support per label; a label never predicted has precision 0."""
    counts = confusion_counts(df, label, prediction, times)
    kind, n, none = counts.schema["label"].dataType, F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(none)
    # each count is seen once as actual and once as predicted, so the rows are scored once
    actual = F.struct(F.col("label"), n.alias("support"), hit.alias("_hit"), none.alias("_said"))
    said = F.struct(
        F.col("prediction").cast(kind).alias("label"), none.alias("support"), none.alias("_hit"), n.alias("_said")
    )
    both = counts.select(F.inline(F.array(actual, said))).groupBy("label")
    sums = both.agg(*[F.sum(c).alias(c) for c in ("support", "_hit", "_said")]).where(F.col("support") > 0)
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("_hit", "_said"), zero)
    recall = F.coalesce(F.try_divide("_hit", "support"), zero)
    scored = sums.select("label", "support", precision.alias("precision"), recall.alias("recall"))
    f = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f", F.coalesce(f, zero))


def class_metrics(df: DataFrame, label: str, prediction: str, times: str | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F as one row."""
    per = label_metrics(df, label, prediction, times)
    total = F.sum("support")
    weighted = {
        name: F.sum(F.col(col) * F.col("support")) / total
        for name, col in (("weighted_precision", "precision"), ("weighted_recall", "recall"), ("weighted_f", "f"))
    }
    # recall weighted by support is the share of rows that are right
    return per.agg(total.alias("n"), *[e.alias(k) for k, e in weighted.items()]).withColumn(
        "accuracy", F.col("weighted_recall")
    )


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score: false and true positive rate when rows with at least that score are called 1."""
    running = value_counts_running(df.where(F.col(label).isNotNull()), [], score, measures={"pos": F.col(label).cast("long")})
    totals = with_totals(running, {"_p": F.sum("pos"), "_n": F.sum("n")})
    above_pos = F.col("_p") - F.col("upto_pos") + F.col("pos")
    above_all = F.col("_n") - F.col("upto") + F.col("n")
    return totals.select(
        score,
        F.try_divide(above_all - above_pos, F.col("_n") - F.col("_p")).alias("fpr"),
        F.try_divide(above_pos, F.col("_p")).alias("tpr"),
    )


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rank-sum AUC with ties at half: each score value meets the negatives below it and half of its own."""
    running = value_counts_running(df.where(F.col(label).isNotNull()), [], score, measures={"pos": F.col(label).cast("long")})
    neg = F.col("n") - F.col("pos")
    neg_below = F.col("upto") - F.col("upto_pos") - neg
    wins = F.sum(F.col("pos") * (neg_below + neg / 2))
    return running.agg(
        F.sum("pos").alias("positives"),
        F.sum(neg).alias("negatives"),
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum(neg)).alias("auc"),
    )


def per_class_accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    right = F.when(F.col(label) == F.col(prediction), 1).otherwise(0)
    return df.groupBy(label).agg(F.sum(right).alias("right"), F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"))


def misclassified_rows(df: DataFrame, label: str, prediction: str, of_class=None) -> DataFrame:
    wrong = F.col(label) != F.col(prediction)
    return df.where(wrong if of_class is None else wrong & (F.col(label) == of_class))


def baseline_log_odds(df: DataFrame, label: str) -> DataFrame:
    p = F.avg(label)
    return df.agg(F.log(p / (1 - p)).alias("intercept"))


def horse_race_row(df: DataFrame, model: str, label: str, prediction: str, date: str, weight: str, resp: str) -> DataFrame:
    """One row of the race: accuracy and utility of acting on the predictions."""
    accuracy = df.agg(F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)).alias("accuracy"))
    utility = utility_score(df, date, weight, resp, prediction)
    return accuracy.select(F.lit(model).alias("model"), "accuracy", utility.select("utility").scalar().alias("utility"))


def permuted(df: DataFrame, key: Sequence[str], col: str, seed: int) -> DataFrame:
    """Shuffle one column: row i in one hash order takes the value of row i in another.

    Both orders are numbered block-wise, and the two sides meet on the row number.
    """
    def order(s: int, *extra: str) -> DataFrame:
        hashed = df.select(*extra, *[c for c in key if c not in extra]).withColumn("_h", seeded_hash(key, s))
        return numbered(hashed.withColumn("_block", F.substring("_h", 1, 3)), [], ["_h", *key], "_block", "_rn")

    rows = order(seed, *df.columns).drop("_h", "_block", col)
    donors = order(seed + 1, col).select("_rn", col)
    return rows.join(donors, "_rn").drop("_rn").select(*df.columns)


def permutation_importance(
    df: DataFrame, key: Sequence[str], features: Sequence[str], label: str, predict: Column, seed: int
) -> DataFrame:
    """``feature, importance``: accuracy lost when a feature is shuffled and the rows are scored again.

    Every feature has a shuffle of its own (``permuted``), from two hash orders that nothing else uses.
    """
    def right(frame: DataFrame) -> Column:
        return frame.withColumn("_p", predict).agg(
            F.avg(F.when(F.col("_p") == F.col(label), 1.0).otherwise(0.0)).alias("a")
        )

    base = right(df).scalar()
    out = None
    for i, feature in enumerate(features):
        one = right(permuted(df, key, feature, seed + 2 * i)).select(F.lit(feature).alias("feature"), F.col("a").alias("_a"))
        out = one if out is None else out.unionByName(one)
    return out.select("feature", (base - F.col("_a")).alias("importance"))


def importance_summary(cycles: DataFrame, k: int = 10) -> DataFrame:
    """Mean absolute importance over cycles, min-max scaled, the k largest."""
    mean = cycles.groupBy("feature").agg(F.avg(F.abs("importance")).alias("value_score"))
    scaled = with_totals(mean, {"_lo": F.min("value_score"), "_hi": F.max("value_score")})
    share = F.try_divide(F.col("value_score") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return scaled.select("feature", "value_score", share.alias("scaled")).orderBy(F.desc("value_score"), "feature").limit(k)


def metrics_table(rows: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in rows.items():
        one = df.withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
