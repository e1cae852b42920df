"""Walk-forward training: one model per monthly cycle, all cycles fitted together.

A cycle trains on the months ``[t, t + years)`` and scores the months that
begin ``years_ahead`` later.  Fitting cycle by cycle would read the rows as often
as there are cycles.  Here

* sums that do not depend on the model (counts, label sums, cross products) are
  taken once per month; a window's sums are the difference of two prefix sums;
* the target encoder differs between cycles: per entity the window sums come
  from prefix sums over its months, and so does the entity's encoded value;
* a Newton step of the logistic model is one aggregate over the rows for all
  cycles: a month's rows meet the cycles that train on them in matrix products.

The driver holds a few numbers per month, cycle and pair of features, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feathergrid.operators.blocks import array_sums, matrix
from feathergrid.session import scratch_path


def month_number(day: str | Column) -> Column:
    """Months since year 0."""
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


@dataclass(frozen=True)
class Cycles:
    """``count`` cycles, each ``step`` months after the one before; windows are whole months."""

    train_start: date
    count: int = 300
    train_years: int = 10
    years_ahead: int = 1
    step: int = 1

    def __post_init__(self):
        if min(self.count, self.train_years, self.step) < 1 or self.years_ahead < 0:
            raise ValueError("cycles need a positive count, length and step")

    @property
    def first(self) -> int:
        return self.train_start.year * 12 + self.train_start.month - 1

    @property
    def length(self) -> int:
        return 12 * self.train_years

    @property
    def ahead(self) -> int:
        return 12 * (self.train_years + self.years_ahead)

    @property
    def last(self) -> int:
        """The first month after every training window."""
        return self.first + (self.count - 1) * self.step + self.length

    def trained_on(self, month: int) -> tuple[int, int]:
        """The cycles ``[a, b)`` whose training window holds a month."""
        a = -((self.length - 1 - (month - self.first)) // self.step)
        return max(0, a), max(0, min(self.count, (month - self.first) // self.step + 1))

    def sums(self, monthly: np.ndarray) -> np.ndarray:
        """Window sums of an array of monthly values (months from ``first`` to ``last`` on axis 0)."""
        upto = np.concatenate([np.zeros((1, *monthly.shape[1:])), np.cumsum(monthly, axis=0)])
        start = np.arange(self.count) * self.step
        return upto[start + self.length] - upto[start]

    def table(self, spark: SparkSession) -> DataFrame:
        c = spark.range(self.count).select(F.col("id").cast("int").alias("cycle"))
        start = F.add_months(F.lit(self.train_start), F.col("cycle") * self.step)
        return c.select(
            "cycle",
            start.alias("train_start"),
            F.add_months(start, self.length).alias("train_stop"),
            F.add_months(start, self.ahead).alias("predict_start"),
            F.add_months(start, self.ahead + self.step).alias("predict_stop"),
        )


class WalkForward:
    """Models of all cycles over ``rows(entity, month, label, features)``.

    ``month`` is a date; rows with a null month, label or feature take no part.
    Features are scaled by mean and deviation of the rows; the last coefficient
    is that of the encoder: the smoothed mean label of the entity's training rows,
    the window's mean label for an entity without any.  ``ridge`` penalises all
    but the intercept.  A cycle with fewer than ``least`` training rows or one
    label only has no model.  A null entity is an entity.

    Rows and entity sums are written once below the shared folder; ``drop``
    deletes them.
    """

    def __init__(
        self,
        rows: DataFrame,
        entity: str,
        month: str,
        label: str,
        features: Sequence[str],
        cycles: Cycles,
        smoothing: float = 1.0,
        ridge: float = 1.0,
        least: int = 30,
    ):
        self.spark, self.cycles, self.ridge, self.least, self.smoothing = rows.sparkSession, cycles, ridge, least, smoothing
        self.k = len(features)
        xs = [F.col(c).cast("double") for c in features]
        named = rows.select(
            F.col(entity).alias("entity"), month_number(month).alias("m"), F.col(label).cast("double").alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(xs)]
        ).na.drop(subset=["m", "y", *[f"x{i}" for i in range(self.k)]])
        self.paths = []
        self.rows = self._keep(named, "walk-rows")
        stats = [f(F.col(f"x{i}")) for i in range(self.k) for f in (F.avg, F.stddev_samp)]
        found = self.rows.agg(*stats).first() if stats else ()
        scale = [(m or 0.0, s or 1.0) for m, s in zip(found[::2], found[1::2])]
        z = [((F.col(f"x{i}") - m) / s).alias(f"z{i}") for i, (m, s) in enumerate(scale)]
        self.scaled = self.rows.select("entity", "m", "y", *z)
        self.z = [f"z{i}" for i in range(self.k)]
        self._monthly()
        self._entities()

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        from feathergrid.session import remove_path

        while self.paths:
            remove_path(self.spark, self.paths.pop())

    def _trained(self) -> DataFrame:
        return self.scaled.where(F.col("m").between(self.cycles.first, self.cycles.last - 1))

    def _monthly(self) -> None:
        """Cross products of (1, z, y) by month, then by window."""
        first, width = self.cycles.first, self.k + 2

        def make():
            sums: dict[int, np.ndarray] = {}

            def add(batch: pa.RecordBatch | None):
                if batch is None:
                    return {m: s.ravel() for m, s in sums.items()}
                months = batch.column(0).to_numpy()
                full = np.stack([np.ones(len(months)), *(c.to_numpy() for c in batch.columns[1:])], axis=1)
                for m in np.unique(months):
                    part = full[months == m]
                    at = int(m) - first
                    sums[at] = sums.get(at, 0) + part.T @ part

            return add

        found = array_sums(self._trained().select("m", *self.z, "y"), make)
        monthly = np.zeros((self.cycles.last - first, width, width))
        for at, values in found.items():
            monthly[at] = values.reshape(width, width)
        self.window = self.cycles.sums(monthly)
        self.n, self.hits = self.window[:, 0, 0], self.window[:, 0, -1]
        self.mean = np.divide(self.hits, self.n, out=np.zeros_like(self.n), where=self.n > 0)
        self.fits = (self.n >= self.least) & (self.hits > 0) & (self.hits < self.n)

    def _entities(self) -> None:
        """Per entity the months it has, with count, label sum and feature sums of each."""
        by_month = self._trained().groupBy("entity", "m").agg(
            F.array(F.count(F.lit(1)).cast("double"), F.sum("y"), *[F.sum(z) for z in self.z]).alias("sums")
        )
        listed = by_month.groupBy("entity").agg(F.collect_list("m").alias("months"), F.collect_list("sums").alias("sums"))
        self.entities = self._keep(listed, "walk-entities")

    def _window_sums(self, months: list[int], sums: list[list[float]]) -> np.ndarray:
        monthly = np.zeros((self.cycles.last - self.cycles.first, self.k + 2))
        monthly[np.asarray(months) - self.cycles.first] = sums
        return self.cycles.sums(monthly)

    def _encoded(self, sums: np.ndarray) -> np.ndarray:
        return (sums[:, 1] + self.smoothing * self.mean) / (sums[:, 0] + self.smoothing)

    def _worker(self) -> WalkForward:
        """What tasks need of this object: no session, no DataFrame."""
        light = object.__new__(WalkForward)
        light.cycles, light.k, light.mean, light.smoothing, light.n = self.cycles, self.k, self.mean, self.smoothing, self.n
        return light

    def encoder(self) -> DataFrame:
        """``entity, encoded``: the encoded value of every entity with training rows, for each cycle."""
        me = self._worker()

        def run(batches):
            for batch in batches:
                codes = [
                    me._encoded(me._window_sums(m.as_py(), s.as_py())).tolist() for m, s in zip(batch.column(1), batch.column(2))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(codes, pa.list_(pa.float64()))], names=["entity", "encoded"]
                )

        kind = self.entities.schema["entity"].dataType.simpleString()
        return self.entities.mapInArrow(run, f"entity {kind}, encoded array<double>")

    def linear(self) -> np.ndarray:
        """Coefficients (intercept, features, encoder) of penalised least squares, a row per cycle, NaN without a model."""
        me = self._worker()

        def make():
            total = np.zeros((me.cycles.count, me.k + 3))

            def add(batch: pa.RecordBatch | None):
                if batch is None:
                    return {c: row for c, row in enumerate(total) if row.any()}
                for months, sums in zip(batch.column(1), batch.column(2)):
                    s = me._window_sums(months.as_py(), sums.as_py())
                    code = me._encoded(s)
                    # encoder times (1, z.., y), and its square
                    total[:, 0] += code * s[:, 0]
                    total[:, 1 : me.k + 1] += code[:, None] * s[:, 2:]
                    total[:, -2] += code * s[:, 1]
                    total[:, -1] += code * code * s[:, 0]

            return add

        cross = np.zeros((self.cycles.count, self.k + 3))
        for c, values in array_sums(self.entities, make).items():
            cross[c] = values
        size = self.k + 2
        left, right = np.zeros((self.cycles.count, size, size)), np.zeros((self.cycles.count, size))
        left[:, :-1, :-1] = self.window[:, :-1, :-1]
        left[:, -1, :-1] = left[:, :-1, -1] = cross[:, : self.k + 1]
        left[:, -1, -1] = cross[:, -1]
        right[:, :-1] = self.window[:, :-1, -1]
        right[:, -1] = cross[:, -2]
        return self._solved(left, right)

    def _solved(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        penalty = self.ridge * np.diag([0.0] + [1.0] * (self.k + 1))
        out = np.full(right.shape, np.nan)
        for c in np.flatnonzero(self.fits):
            out[c] = np.linalg.lstsq(left[c] + penalty, right[c], rcond=None)[0]
        return out

    def _coded_rows(self) -> DataFrame:
        """Training rows with the encoded values of the cycles that train on them."""
        c = self.cycles
        since = F.col("m") - c.first
        a = F.greatest(F.lit(0), -F.floor((F.lit(c.length - 1) - since) / c.step)).cast("int")
        b = F.least(F.lit(c.count), (F.floor(since / c.step) + 1).cast("int"))
        coded = self._trained().alias("r").join(self.encoder().alias("e"), F.col("r.entity").eqNullSafe(F.col("e.entity")))
        return coded.where(a < b).select("m", "y", F.array(F.lit(1.0), *self.z).alias("x"), F.slice("encoded", a + 1, b - a).alias("encoded"))

    def logistic(self, steps: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients of the penalised logistic model after ``steps`` Newton steps from 0, and the mean loss before each."""
        rows = self._keep(self._coded_rows(), "walk-coded")
        c, size = self.cycles, self.k + 2
        upper = np.triu_indices(size)
        coef, losses = np.zeros((c.count, size)), []
        for _ in range(steps):
            sums = np.zeros((c.count, size + len(upper[0]) + 1))
            for cycle, values in array_sums(rows, _newton_sums(c, coef, upper)).items():
                sums[cycle] = values
            gradient = sums[:, :size] - self.ridge * np.column_stack([np.zeros(c.count), coef[:, 1:]])
            hessian = np.zeros((c.count, size, size))
            hessian[:, upper[0], upper[1]] = hessian[:, upper[1], upper[0]] = sums[:, size:-1]
            losses.append(np.divide(sums[:, -1], self.n, out=np.full(c.count, np.nan), where=self.fits))
            coef = np.where(self.fits[:, None], coef + np.nan_to_num(self._solved(hessian, gradient)), 0.0)
        return np.where(self.fits[:, None], coef, np.nan), np.array(losses)

    def scores(self, coef: np.ndarray, link: str = "logistic") -> DataFrame:
        """``cycle, month, entity, probability, label`` of the rows to predict of cycles with a model.

        ``probability`` is the linear predictor for ``link="identity"``.
        """
        c = self.cycles
        cycle = F.floor((F.col("m") - c.first - c.ahead) / c.step).cast("int")
        ahead = self.scaled.withColumn("cycle", cycle).where(F.col("cycle").between(0, c.count - 1))
        fitted = [(i, [float(v) for v in row], float(self.mean[i])) for i, row in enumerate(coef) if not np.isnan(row).any()]
        models = self.spark.createDataFrame(fitted, "cycle int, coef array<double>, mean double")
        rows = ahead.join(F.broadcast(models), "cycle").alias("r")  # one row per cycle
        coded = rows.join(self.encoder().alias("e"), F.col("r.entity").eqNullSafe(F.col("e.entity")), "left")
        code = F.coalesce(F.element_at("encoded", F.col("cycle") + 1), F.col("mean"))
        eta = F.element_at("coef", 1)
        for i, x in enumerate([*[F.col(z) for z in self.z], code], 2):
            eta = eta + F.element_at("coef", i) * x
        value = 1 / (1 + F.exp(-eta)) if link == "logistic" else eta
        month = F.make_date(F.floor(F.col("m") / 12).cast("int"), (F.col("m") % 12 + 1).cast("int"), F.lit(1))
        return coded.select("cycle", month.alias("month"), F.col("r.entity").alias("entity"), value.alias("probability"), F.col("y").alias("label"))


def _newton_sums(cycles: Cycles, coef: np.ndarray, upper: tuple[np.ndarray, np.ndarray]):
    """Per cycle: gradient, upper half of the negative Hessian and loss at ``coef`` over its training rows."""
    size = coef.shape[1]
    inner = np.triu_indices(size - 1)
    # where the pairs of features and those with the encoder lie in the upper half
    where_inner = np.flatnonzero(upper[1] < size - 1)
    where_code = np.flatnonzero(upper[1] == size - 1)

    def make():
        total = np.zeros((cycles.count, size + len(upper[0]) + 1))

        def add(batch: pa.RecordBatch | None):
            if batch is None:
                return {c: row for c, row in enumerate(total) if row.any()}
            months = batch.column(0).to_numpy()
            for m in np.unique(months):
                a, b = cycles.trained_on(int(m))
                part = batch.filter(pa.array(months == m))
                y, x, e = part.column(1).to_numpy()[:, None], matrix(part.column(2)), matrix(part.column(3))
                eta = x @ coef[a:b, :-1].T + e * coef[a:b, -1]
                p = 1 / (1 + np.exp(-eta))
                weight, rest = p * (1 - p), y - p
                here = total[a:b]
                here[:, : size - 1] += (x.T @ rest).T
                here[:, size - 1] += (e * rest).sum(axis=0)
                here[:, size + where_inner] += ((x[:, inner[0]] * x[:, inner[1]]).T @ weight).T
                coded = weight * e
                here[:, size + where_code[:-1]] += (x.T @ coded).T
                here[:, size + where_code[-1]] += (coded * e).sum(axis=0)
                here[:, -1] += (np.logaddexp(0, eta) - y * eta).sum(axis=0)

        return add

    return make
