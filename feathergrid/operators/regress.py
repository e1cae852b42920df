"""Least squares, panel regressions, binomial models and time-series tables.

Regressions read the data through one aggregate of means and covariances (k
columns give k*(k+1)/2 numbers); only that small matrix reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feathergrid.operators.binomial import binomial_glm, bootstrap_ci, likelihood_ratio, wald_interval  # noqa: F401
from feathergrid.operators.ordered import join_groups
from feathergrid.operators.series import along
from feathergrid.operators.tails import chi2_tail


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and centred cross products of the columns, from one aggregate row."""
    k = len(cols)
    known = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).na.drop()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = known.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)],
        *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    cross = np.zeros((k, k))
    for i, j in pairs:
        cross[i, j] = cross[j, i] = (row[f"c{i}_{j}"] or 0.0) * row["n"]
    return row["n"], np.array([row[f"m{i}"] for i in range(k)], dtype=float), cross


class Fit:
    """Least-squares fit of y on xs with an intercept."""

    def __init__(self, n: int, means: np.ndarray, cross: np.ndarray, names: Sequence[str], used: int | None = None):
        self.n, self.names = n, list(names)
        sxx, sxy, self.tss = cross[1:, 1:], cross[1:, 0], cross[0, 0]
        self.inverse = np.linalg.inv(sxx)
        slopes = self.inverse @ sxy
        self.centre = means[1:]
        self.coef = np.concatenate([[means[0] - slopes @ means[1:]], slopes])
        self.rss = max(float(self.tss - slopes @ sxy), 0.0)
        self.df = n - (used if used is not None else len(slopes) + 1)
        sigma2 = self.rss / self.df
        var0 = 1 / n + means[1:] @ self.inverse @ means[1:]
        self.se = np.sqrt(sigma2 * np.concatenate([[var0], np.diag(self.inverse)]))
        self.r2 = 1 - self.rss / self.tss

    def predict(self, cols: Mapping[str, Column] | None = None) -> Column:
        out = F.lit(float(self.coef[0]))
        for name, b in zip(self.names, self.coef[1:], strict=True):
            out = out + (cols[name] if cols else F.col(name)) * float(b)
        return out

    @property
    def aic(self) -> float:
        k = len(self.coef) + 1
        if self.rss == 0:
            return -math.inf
        return self.n * (math.log(2 * math.pi) + math.log(self.rss / self.n) + 1) + 2 * k

    def table(self, spark: SparkSession) -> DataFrame:
        terms = ["(intercept)", *self.names]
        rows = [(t, float(b), float(s), float(b / s)) for t, b, s in zip(terms, self.coef, self.se, strict=True)]
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, t double")


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> Fit:
    return Fit(*moments(df, [y, *xs]), names=xs)


def ols_summary(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """Coefficients with standard error, t and p, and R2, adjusted R2 and n, from the normal equations."""
    data = VectorAssembler(inputCols=list(xs), outputCol="_x", handleInvalid="skip").transform(df)
    summary = LinearRegression(featuresCol="_x", labelCol=y, solver="normal").fit(data)
    s, coef = summary.summary, [*summary.coefficients.toArray(), summary.intercept]
    names = [*xs, "(intercept)"]
    rows = [
        (n, float(c), float(e), float(t), float(p))
        for n, c, e, t, p in zip(names, coef, s.coefficientStandardErrors, s.tValues, s.pValues, strict=True)
    ]
    table = df.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t double, p double")
    return table, {"r2": s.r2, "adj_r2": s.r2adj, "n": s.numInstances}


def vif(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """1 / (1 - R2_j): the diagonal of the inverse correlation matrix."""
    _, _, cross = moments(df, xs)
    scale = np.sqrt(np.diag(cross))
    inverse = np.linalg.inv(cross / np.outer(scale, scale))
    rows = [(x, float(v)) for x, v in zip(xs, np.diag(inverse), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, vif double")


def breusch_pagan(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """n * R2 of the squared residuals on the predictors, with its chi-square p."""
    first = ols(df, y, xs)
    residual = F.col(y) - first.predict()
    second = ols(df.select(*xs, (residual * residual).alias("_e2")), "_e2", xs)
    statistic = second.n * second.r2
    row = [(float(statistic), len(xs), chi2_tail(statistic, len(xs)))]
    return df.sparkSession.createDataFrame(row, "statistic double, df int, p double")


def factor_dummies(df: DataFrame, factor: str, levels: Sequence, prefix: str) -> DataFrame:
    """0/1 columns for every level but the first; a level that is not listed stops the query."""
    strange = F.col(factor).isNotNull() & ~F.col(factor).isin(list(levels))
    told = F.raise_error(F.concat(F.lit(f"{factor}: level not listed: "), F.col(factor).cast("string"))).cast("int")
    df = df.withColumn(factor, F.when(strange, told).otherwise(F.col(factor)))
    return df.withColumns({f"{prefix}{v}": F.when(F.col(factor) == v, 1).otherwise(0) for v in list(levels)[1:]})


def demean(df: DataFrame, entity: str, cols: Sequence[str]) -> DataFrame:
    """Columns minus their entity mean; means are an aggregate joined back, not a window over the entity."""
    means = df.groupBy(entity).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    joined = join_groups(df, means, [entity])
    return joined.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def fixed_effects(
    df: DataFrame, entity: str, y: str, xs: Sequence[str], period: str | None = None, periods: Sequence | None = None
) -> tuple[Fit, DataFrame]:
    """Within regression, with period dummies if asked; returns the fit and the demeaned rows."""
    names, rows = list(xs), df
    if period is not None:
        rows = factor_dummies(df, period, periods, f"{period}_")
        names += [f"{period}_{p}" for p in list(periods)[1:]]
    within = demean(rows, entity, [y, *names])
    n, means, cross = moments(within, [y, *names])
    entities = df.select(entity).distinct().count()
    return Fit(n, means, cross, names, used=entities + len(names)), within


def clustered_se(within: DataFrame, fit: Fit, entity: str, y: str, leverage: bool = False) -> DataFrame:
    """Arellano standard errors: residual scores are summed per entity before the outer product.

    With ``leverage`` (HC3) a residual is first divided by one minus its row's
    diagonal of the hat matrix of the demeaned columns.
    """
    e = F.col(y) - fit.predict()
    if leverage:
        hat = F.lit(0.0)
        for i, a in enumerate(fit.names):
            for j, b in enumerate(fit.names):
                hat = hat + F.col(a) * F.col(b) * float(fit.inverse[i, j])
        e = e / (1 - hat)
    rows = within.withColumn("_e", e)
    sums = rows.groupBy(entity).agg(*[F.sum(F.col(x) * F.col("_e")).alias(f"s{i}") for i, x in enumerate(fit.names)])
    return _sandwich(within.sparkSession, sums, fit)


def hc3_se(df: DataFrame, fit: Fit, y: str) -> DataFrame:
    """White HC3 standard errors of the slopes: squared residuals are inflated by their leverage."""
    d = [F.col(x) - float(c) for x, c in zip(fit.names, fit.centre, strict=True)]
    leverage = F.lit(1.0 / fit.n)
    for i, a in enumerate(d):
        for j, b in enumerate(d):
            leverage = leverage + a * b * float(fit.inverse[i, j])
    weight = (F.col(y) - fit.predict()) / (1 - leverage)
    scores = df.select(*[(x * weight).alias(f"s{i}") for i, x in enumerate(d)])
    return _sandwich(df.sparkSession, scores, fit)


def _sandwich(spark: SparkSession, scores: DataFrame, fit: Fit) -> DataFrame:
    k = len(fit.names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = scores.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((k, k))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = row[f"m{i}_{j}"]
    se = np.sqrt(np.diag(fit.inverse @ meat @ fit.inverse))
    rows = [(n, float(b), float(s), float(b / s)) for n, b, s in zip(fit.names, fit.coef[1:], se, strict=True)]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, t double")


# --- trend and season ----------------------------------------------------------------------------
def trend_columns(series: DataFrame, keys: Sequence[str], order: str, season: bool = False) -> DataFrame:
    """Time index t, its square, and month dummies; a series has one row per period."""
    out = series.withColumn("t", F.row_number().over(along(keys, [order])).cast("double"))
    out = out.withColumn("t2", F.col("t") * F.col("t"))
    if season:
        out = factor_dummies(out.withColumn("m", F.month(order)), "m", range(1, 13), "m")
    return out


TREND_TERMS = {"linear": ["t"], "quadratic": ["t", "t2"], "seasonal": ["t", *[f"m{i}" for i in range(2, 13)]]}


def trend_season_regression(series: DataFrame, keys: Sequence[str], order: str, y: str) -> tuple[dict[str, Fit], DataFrame]:
    """Linear, quadratic, log-linear and seasonal fits; returns them and a table of SSE and AIC."""
    data = trend_columns(series, keys, order, season=True).withColumn("_log", F.log(y)).cache()
    fits = {name: ols(data, y, terms) for name, terms in TREND_TERMS.items()}
    fits["log"] = ols(data, "_log", ["t"])
    rows = [(name, float(f.rss), float(f.aic)) for name, f in fits.items()]
    return fits, series.sparkSession.createDataFrame(rows, "model string, sse double, aic double")


def trend_fitted(series: DataFrame, keys: Sequence[str], order: str, y: str) -> DataFrame:
    """``keys, order, model, fitted, residual`` of every period and model; the log-linear one on the log scale."""
    fits, _ = trend_season_regression(series, keys, order, y)
    data = trend_columns(series, keys, order, season=True)
    rows = [
        F.struct(
            F.lit(name).alias("model"),
            fit.predict().alias("fitted"),
            ((F.log(y) if name == "log" else F.col(y)) - fit.predict()).alias("residual"),
        )
        for name, fit in fits.items()
    ]
    return data.select(*keys, order, F.inline(F.array(*rows)))


def trend_forecast(series: DataFrame, order: str, y: str, fit: Fit, horizon: int) -> DataFrame:
    """Predictions of a trend fit for the ``horizon`` months after the last one."""
    last = series.agg(F.max(order).alias("d"), F.count(F.lit(1)).alias("n"))
    steps = last.select("d", "n", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    t = (F.col("n") + F.col("h")).cast("double")
    return steps.select(F.add_months("d", F.col("h")).alias(order), fit.predict({"t": t, "t2": t * t}).alias(y))


def forecast_accuracy(actual: DataFrame, forecast: DataFrame, on: Sequence[str], y: str, predicted: str) -> DataFrame:
    """ME, RMSE, MAE, MPE and MAPE of a forecast against the actuals."""
    e = F.col(y) - F.col(predicted)
    share = F.try_divide(e, F.col(y)) * 100
    return actual.join(forecast, list(on)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e).alias("me"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(share).alias("mpe"),
        F.avg(F.abs(share)).alias("mape"),
    )


def ljung_box(acf_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q = n (n + 2) sum rho_k^2 / (n - k) from an autocorrelation table."""
    term = F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag"))
    q = F.max("n") * (F.max("n") + 2) * F.sum(term)
    return acf_table.groupBy(*keys).agg(q.alias("q"), F.count("lag").alias("lags"))


def classical_decompose(series: DataFrame, keys: Sequence[str], order: str, y: str) -> DataFrame:
    """Additive: centred 2x12 moving average, centred month means of the rest, remainder."""
    w = along(keys, [order])
    wide, inner = w.rowsBetween(-6, 6), w.rowsBetween(-5, 5)
    ends = F.lag(y, 6).over(w) + F.lead(y, 6).over(w)
    trend = F.when(F.count(y).over(wide) == 13, (F.sum(y).over(inner) + ends / 2) / 12)
    out = series.withColumn("trend", trend).withColumn("_d", F.col(y) - F.col("trend")).withColumn("_m", F.month(order))
    means = out.groupBy(*keys, "_m").agg(F.avg("_d").alias("_s"))
    centred = means.withColumn("seasonal", F.col("_s") - F.avg("_s").over(W.partitionBy(*keys))).drop("_s")
    joined = out.join(centred, [*keys, "_m"])
    return joined.withColumn("remainder", F.col("_d") - F.col("seasonal")).drop("_d", "_m")


def rates_per_capita(df: DataFrame, rates: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """``{name: (part, whole, scale)}``; a whole of 0 gives null."""
    return df.withColumns({n: F.try_divide(p, w) * s for n, (p, w, s) in rates.items()})
