"""Feature preparation and time-ordered splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feathergrid.functions.columns import map_literal
from feathergrid.operators.ordered import exact_percentiles, join_groups, numbered
from feathergrid.operators.rows import seeded_hash

# Hash prefixes cut a group into 4096 blocks when rows are numbered in hash order.
_PREFIX = 3


def index_categoricals(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Label indices by frequency in ``train``; an unseen label gets one extra bucket."""
    model = StringIndexer(
        inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep"
    ).fit(train)
    return model.transform(df)


def one_hot(df: DataFrame, cols: Sequence[str], drop_last: bool = True) -> DataFrame:
    """One-hot vectors of index columns as arrays."""
    encoder = OneHotEncoder(inputCols=list(cols), outputCols=[f"{c}_vec" for c in cols], dropLast=drop_last)
    out = encoder.fit(df).transform(df)
    return out.withColumns({f"{c}_class": vector_to_array(f"{c}_vec") for c in cols}).drop(*[f"{c}_vec" for c in cols])


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact median of the column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "_column", "_value")
    medians = exact_percentiles(long, ["_column"], "_value", {"m": 0.5})  # one row per column
    wide = medians.agg(F.struct(*[F.max(F.when(F.col("_column") == c, F.col("m"))).alias(c) for c in cols]).alias("m")).scalar()
    filled = df.withColumn("_medians", wide)
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_medians").getField(c)) for c in cols}).drop("_medians")


def assemble(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="skip").transform(df)


def standardize(df: DataFrame, col: str = "features", name: str = "scaled") -> DataFrame:
    return StandardScaler(inputCol=col, outputCol=name, withMean=True, withStd=True).fit(df).transform(df)


def holdout_by_time(df: DataFrame, period: Column, held: int) -> tuple[DataFrame, DataFrame]:
    return df.where(period != held), df.where(period == held)


def hash_fraction(key: Sequence[str], seed: int) -> Column:
    """Uniform number in [0, 1) that depends on key and seed only."""
    return F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("double") / float(2**32)


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], seed: int, shares: Mapping[str, float]
) -> DataFrame:
    """Exact shares per label: rows are numbered in hash order inside their label.

    Numbering runs per (label, hash prefix), so a label with most rows is spread
    over thousands of pieces.
    """
    hashed = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_block", F.substring("_h", 1, _PREFIX))
    ranked = numbered(hashed, [label], ["_h", *key], "_block", "_rn")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    joined = join_groups(ranked, sizes, [label])
    position = (F.col("_rn") - 1) / F.col("_n")
    names = list(shares)
    split, upto = F, 0.0
    for name in names[:-1]:
        upto = round(upto + shares[name], 10)
        split = split.when(position < upto, name)
    return joined.withColumn("data_type", split.otherwise(names[-1])).drop("_h", "_block", "_rn", "_n")


def random_split(df: DataFrame, key: Sequence[str], seed: int, shares: Mapping[str, float]) -> DataFrame:
    """Shuffled split by hash: no shuffle, and the same row always lands in the same part."""
    position = hash_fraction(key, seed)
    names = list(shares)
    split, upto = F, 0.0
    for name in names[:-1]:
        upto = round(upto + shares[name], 10)
        split = split.when(position < upto, name)
    return df.withColumn("data_type", split.otherwise(names[-1]))


def class_ratio(df: DataFrame, label: str) -> float:
    row = df.agg(F.count_if(F.col(label) == 0).alias("major"), F.count_if(F.col(label) == 1).alias("minor")).first()
    return row["major"] / row["minor"] if row["minor"] else 1.0


def oversample_minority(df: DataFrame, label: str, key: Sequence[str], seed: int) -> DataFrame:
    """Repeat label-1 rows until the classes balance: whole copies, and a hashed share of one more."""
    ratio = class_ratio(df, label)
    whole = int(ratio)
    extra = F.when(hash_fraction(key, seed) < ratio - whole, 1).otherwise(0)
    copies = F.when(F.col(label) == 1, F.lit(whole) + extra).when(F.col(label) == 0, F.lit(1)).otherwise(F.lit(0))
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("_copy")


def oversample_poisson(df: DataFrame, label: str, seed: int) -> DataFrame:
    """Sampling with replacement at the class ratio; counts are balanced on average."""
    minor = df.where(F.col(label) == 1).sample(True, class_ratio(df, label), seed)
    return df.where(F.col(label) == 0).unionAll(minor)


def oversample_inside_fold(train: DataFrame, label: str, key: Sequence[str], seed: int) -> DataFrame:
    """Balance a training fold after the split, so no copy reaches the validation fold."""
    return oversample_minority(train, label, key, seed)


def fold_column(df: DataFrame, period: Column, periods: Sequence[int], name: str = "fold") -> DataFrame:
    """Period to fold number through a literal map."""
    folds = {p: i for i, p in enumerate(sorted(periods))}
    return df.withColumn(name, map_literal(folds, period))


class TimeSeriesCrossValidator(CrossValidator):
    """Fold i trains on folds up to i and validates on fold i + 1; an empty side is an error."""

    def _kFold(self, dataset):  # noqa: N802
        fold_col, folds = self.getOrDefault(self.foldCol), self.getOrDefault(self.numFolds)
        if not fold_col:
            raise ValueError("set foldCol to a time-ordered fold number")
        sizes = {r[0]: r[1] for r in dataset.groupBy(fold_col).count().collect()}  # one row per fold
        bad = [f for f in sizes if f is None or not 0 <= f <= folds]
        if bad:
            raise ValueError(f"fold numbers must be in [0, {folds}], found {bad}")
        fold, pairs = F.col(fold_col), []
        for i in range(folds):
            if not any(sizes.get(j) for j in range(i + 1)):
                raise ValueError(f"the training data at fold {i} is empty")
            if not sizes.get(i + 1):
                raise ValueError(f"the validation data at fold {i} is empty")
            pairs.append((dataset.where(fold <= i), dataset.where(fold == i + 1)))
        return pairs


def walk_forward_windows(
    calendar: DataFrame, month: str, cycles: int, train_years: int, years_ahead: int = 1, step: int = 1
) -> DataFrame:
    """Monthly cycles ``(cycle, train_start, train_stop, predict_start, predict_stop)``.

    The first cycle trains from the first month on; prediction starts
    ``years_ahead`` after training ends, when its labels are known.
    """
    first = calendar.agg(F.min(month).alias("m"))
    cycle = first.select("m", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))).alias("cycle"))
    start = F.add_months("m", F.col("cycle") * step)
    return cycle.select(
        "cycle",
        start.alias("train_start"),
        F.add_months(start, 12 * train_years).alias("train_stop"),
        F.add_months(start, 12 * (train_years + years_ahead)).alias("predict_start"),
        F.add_months(start, 12 * (train_years + years_ahead) + step).alias("predict_stop"),
    )


def assign_cycles(monthly: DataFrame, month: str, windows: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows keyed by month start, once per cycle window they fall in, by an equi join on the month."""
    last = F.add_months(stop, -1)
    months = windows.select("cycle", F.explode(F.sequence(F.col(start), last, F.expr("interval 1 month"))).alias(month))
    return monthly.join(months, month)


def target_encode(train: DataFrame, df: DataFrame, entity: str, label: str, smoothing: float = 1.0) -> DataFrame:
    """Entity to smoothed mean label of the training rows; an unseen entity gets the overall mean."""
    overall = train.agg(F.avg(label)).scalar()
    stats = train.groupBy(entity).agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
    joined = df.join(stats, entity, "left")
    smooth = (F.col("_s") + smoothing * overall) / (F.col("_n") + smoothing)
    return joined.withColumn(f"{entity}_enc", F.coalesce(smooth, overall)).drop("_s", "_n")
