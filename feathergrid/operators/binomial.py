"""Binomial models by reweighted least squares, their tests and intervals, and the bootstrap.

A Newton step is one aggregate: tasks add up gradient and Hessian of their rows.
The bootstrap takes the steps of all replicates in the same aggregate; a row's
weight in a replicate is a Poisson(1) number hashed from row key and replicate,
so no row is copied and no replicate is a group.  The gradient of every replicate
is expanded around the full fit, whose sums need one pass; a bound on what the
expansion leaves out says which replicates are settled by it, and only if some
are not do Newton steps over the rows follow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feathergrid.operators.blocks import array_sums
from feathergrid.operators.tails import chi2_tail
from feathergrid.session import scratch_path

# fixed value: normal quantile of a 95 % interval
Z95 = 1.959963984540054
# rows whose weights of all replicates are held at a time: the arrays stay in a core's cache
CHUNK = 64
# highest derivative of the logistic function in the expansion of a replicate's gradient, and a bound on the next one
ORDER, NEXT_DERIVATIVE = 4, 0.25


class BinomialFit:
    """Coefficients (intercept first), covariance and deviance of a logit model of successes in trials."""

    def __init__(self, names: Sequence[str], coef: np.ndarray, covariance: np.ndarray, deviance: float, steps: int):
        self.names, self.coef, self.covariance = ["(intercept)", *names], coef, covariance
        self.deviance, self.steps = deviance, steps
        self.se = np.sqrt(np.diag(covariance))
        self.intercept, self.coefficients = coef[0], coef[1:]

    def rows(self) -> list[tuple[str, float, float, float, float]]:
        """term, estimate, standard error, z and two-sided p."""
        z = self.coef / self.se
        return [
            (n, float(b), float(s), float(v), math.erfc(abs(v) / math.sqrt(2))) for n, b, s, v in zip(self.names, self.coef, self.se, z)
        ]


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _entropy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a ln(a / b), 0 where a is 0."""
    return np.where(a > 0, a * np.log(np.where(a > 0, a, 1) / b), 0.0)


def _glm_sums(beta: np.ndarray):
    """Gradient, Hessian and deviance at ``beta`` of rows (won, n, offset, x..)."""

    def make():
        size = len(beta)
        total = np.zeros(size + size * size + 1)

        def add(batch: pa.RecordBatch | None):
            if batch is None:
                return {0: total}
            won, n, offset, *xs = _columns(batch)
            design = np.column_stack([np.ones(len(won)), *xs])
            eta = design @ beta + offset
            p = 1 / (1 + np.exp(-eta))
            total[:size] += design.T @ (won - n * p)
            total[size:-1] += (design.T @ ((n * p * (1 - p))[:, None] * design)).ravel()
            total[-1] += 2 * (_entropy(won, n * p) + _entropy(n - won, n * (1 - p))).sum()

        return add

    return make


def fit_binomial(
    df: DataFrame, successes: str, trials: str, xs: Sequence[str], offset: str | None = None, steps: int = 50, tol: float = 1e-10
) -> BinomialFit:
    """Logit model of ``successes`` in ``trials``; interactions and squares are columns of ``xs``.

    ``offset`` is added to the linear predictor as it is.  Rows with a null or
    without trials take no part.  Steps stop when no coefficient moves by more
    than ``tol`` of its scale; a separated sample stops after ``steps``.
    """
    shift = F.col(offset).cast("double") if offset else F.lit(0.0)
    cols = [F.col(successes).cast("double").alias("won"), F.col(trials).cast("double").alias("n"), shift.alias("o")]
    cols += [F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)]
    rows = df.select(*cols).na.drop().where("n > 0")
    spread = rows.agg(F.sum("won").alias("won"), F.sum("n").alias("n"), F.avg("o").alias("o")).first()
    if not spread["n"] or not 0 < spread["won"] < spread["n"]:
        raise ValueError("a binomial model needs successes and failures")
    size = len(xs) + 1
    beta = np.zeros(size)
    beta[0] = math.log(spread["won"] / (spread["n"] - spread["won"])) - spread["o"]
    for step in range(1, steps + 1):
        sums = array_sums(rows, _glm_sums(beta))[0]
        hessian, deviance = sums[size:-1].reshape(size, size), sums[-1]
        move = np.linalg.solve(hessian, sums[:size])
        if np.all(np.abs(move) <= tol * (1 + np.abs(beta))):
            break
        beta = beta + move
    return BinomialFit(xs, beta, np.linalg.inv(hessian), float(deviance), step)


def binomial_glm(
    df: DataFrame, successes: str, trials: str, xs: Sequence[str], offset: str | None = None
) -> tuple[DataFrame, BinomialFit]:
    """The fit as a table ``term, estimate, std_error, z, p``, and the fit."""
    fit = fit_binomial(df, successes, trials, xs, offset)
    return df.sparkSession.createDataFrame(fit.rows(), "term string, estimate double, std_error double, z double, p double"), fit


def likelihood_ratio(df: DataFrame, successes: str, trials: str, small: Sequence[str], big: Sequence[str]) -> DataFrame:
    """Deviance difference of nested binomial models and its chi-square p."""
    a = fit_binomial(df, successes, trials, small).deviance
    b = fit_binomial(df, successes, trials, big).deviance
    step = len(big) - len(small)
    return df.sparkSession.createDataFrame([(a - b, step, chi2_tail(a - b, step))], "deviance double, df int, p double")


def wald_interval(df: DataFrame, successes: str, trials: str, x: str, at: Sequence[float], z: float = Z95) -> DataFrame:
    """Probability and confidence bounds at given x: the interval is built on the logit scale."""
    fit = fit_binomial(df, successes, trials, [x])
    rows = []
    for v in at:
        here = np.array([1.0, v])
        eta, sd = float(here @ fit.coef), math.sqrt(here @ fit.covariance @ here)
        rows.append((float(v), *[1 / (1 + math.exp(-e)) for e in (eta, eta - z * sd, eta + z * sd)]))
    return df.sparkSession.createDataFrame(rows, "x double, probability double, lower double, upper double")


# --- bootstrap --------------------------------------------------------------------------------------
#: Hashes live below this prime.
PRIME = 2**31 - 1
#: Multipliers and shifts of the rounds of the hash.
ROUNDS = ((15, 48271), (13, 69621), (16, 40692))
#: A Poisson(1) number is how many of these a uniform hash reaches; the rest beyond is below 1e-9.
POISSON = tuple(math.ceil(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12))


#: Weights by the leading bits of a hash; NaN where an edge lies among the hashes with these bits.
LOW_BITS = 16
_STARTS = np.arange(2 ** (31 - LOW_BITS), dtype=np.int64) << LOW_BITS
WEIGHTS = np.searchsorted(POISSON, _STARTS, side="right").astype(np.float64)
WEIGHTS[[edge >> LOW_BITS for edge in POISSON]] = np.nan


def hashed(z: np.ndarray) -> np.ndarray:
    for shift, factor in ROUNDS:
        z = (z ^ (z >> shift)) * factor % PRIME
    return z


def _hash_matrix(z: np.ndarray) -> np.ndarray:
    """``hashed`` of numbers below 2**31, in place."""
    part = np.empty_like(z)
    for shift, factor in ROUNDS:
        np.right_shift(z, shift, out=part)
        z ^= part
        z *= factor
        # modulo 2**31 - 1: what lies above 31 bits is added to the rest, then the prime taken off once if reached
        np.right_shift(z, 31, out=part)
        z &= PRIME
        z += part
        np.add(z, 1, out=part)
        part >>= 31
        z += part
        z &= PRIME
    return z


def row_weights(keys: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Poisson(1) weights, rows by replicates; ``lanes`` are the replicates' hashes."""
    z = _hash_matrix(hashed(keys % PRIME)[:, None] ^ lanes)
    out = WEIGHTS[z >> LOW_BITS]
    near = np.isnan(out)
    out[near] = np.searchsorted(POISSON, z[near], side="right")
    return out


def _lanes(replicates: int, seed: int) -> np.ndarray:
    return hashed(np.arange(1, replicates + 1, dtype=np.int64) + seed * 1_000_003)


def _drawn(won, n, key, p, replicates, seed):
    """Successes of rows in each replicate, drawn from the fitted probabilities; a row's draws depend on its key alone."""
    return np.stack([np.random.default_rng([seed, int(k) & (2**63 - 1)]).binomial(int(t), q, replicates) for t, q, k in zip(n, p, key)])


def _powers(order: int) -> list[tuple[int, int]]:
    """Pairs (m, j): sums of the m-th derivative times the j-th power of x that the expansion needs."""
    return [(m, j) for m in range(order + 1) for j in range(m + 2)]


def _slopes(order: int) -> list[np.polynomial.Polynomial]:
    """The logistic function and its derivatives, as polynomials of its value."""
    out = [np.polynomial.Polynomial([0.0, 1.0])]
    while len(out) <= order:
        out.append(out[-1].deriv() * np.polynomial.Polynomial([0.0, 1.0, -1.0]))
    return out


def _bootstrap_moments(base: np.ndarray, centre: float, scale: float, replicates: int, seed: int, parametric: bool):
    """Per replicate: sums of won, x won, trials and the terms of ``_powers`` at the full fit, x centred and scaled."""
    lanes, slopes = _lanes(replicates, seed), _slopes(ORDER)

    def make():
        total = np.zeros((3 + len(_powers(ORDER)), replicates))

        def add(batch: pa.RecordBatch | None):
            if batch is None:
                return dict(enumerate(total))
            x, won, n, key = _columns(batch)
            p = 1 / (1 + np.exp(-(base[0] + base[1] * x)))
            z = (x - centre) / scale
            design, steep = np.stack([np.ones(len(x)), z]), [slope(p) for slope in slopes]
            terms = np.stack([n, *[n * steep[m] * z**j for m, j in _powers(ORDER)]])
            if parametric:
                total[2:] += terms.sum(axis=1)[:, None]
            else:
                terms = np.concatenate([design * won, terms])
            for s in range(0, len(x), CHUNK):
                few = slice(s, s + CHUNK)
                if parametric:
                    total[:2] += design[:, few] @ _drawn(won[few], n[few], key[few], p[few], replicates, seed)
                else:
                    total[:] += terms[:, few] @ row_weights(key[few], lanes)

        return add

    return make


def _expanded_fits(won: np.ndarray, terms: np.ndarray, reach: float, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Moves (2 x replicates, x centred and scaled) that bring the expanded gradient to 0, and bounds on their error."""
    sums = dict(zip(_powers(ORDER), terms[1:]))
    move = np.zeros_like(won)

    def around(d0, d1, power, order):
        """Sum of z**power times the logistic function's ``order``-th derivative, expanded."""
        out = 0.0
        for m in range(ORDER + 1 - order):
            for j in range(m + 1):
                out = out + math.comb(m, j) / math.factorial(m) * d0 ** (m - j) * d1**j * sums[m + order, j + power]
        return out

    with np.errstate(all="ignore"):
        for _ in range(steps):
            g, h = won[0] - around(*move, 0, 0), won[1] - around(*move, 1, 0)
            a, b, c = (around(*move, power, 1) for power in range(3))
            det = a * c - b * b
            step = np.stack([c * g - b * h, a * h - b * g]) / det
            move = move + step
            if np.all(np.abs(step) <= 1e-13 * (1 + np.abs(move))):
                break
        # what the expansion leaves out of both gradients, through the inverse of the Hessian
        far = np.abs(move[0]) + np.abs(move[1]) * reach
        # rows of weight 0 add nothing, so the next derivative's bound times all trials bounds the rest
        left = terms[0] * NEXT_DERIVATIVE * far ** (ORDER + 1) / math.factorial(ORDER + 1)
        error = np.stack([np.abs(c) + np.abs(b) * reach, np.abs(a) * reach + np.abs(b)]) * left / np.abs(det)
    return move, np.where(np.isfinite(error) & np.isfinite(move) & (det > 0), error, np.inf)


def _bootstrap_sums(beta: np.ndarray, replicates: int, seed: int, parametric: bool):
    """Per replicate: sums of (np, x np, v, x v, x x v) at ``beta``, v = np(1 - p)."""
    lanes = _lanes(replicates, seed)

    def make():
        total = np.zeros((5, replicates))

        def few(x, won, n, key):
            design = np.stack([np.ones(len(x)), x])
            weight = np.ones((len(x), replicates)) if parametric else row_weights(key, lanes)
            p = 1 / (1 + np.exp(-np.clip(design.T @ beta, -30, 30)))
            weight *= n[:, None]
            weight *= p
            first = design @ weight
            weight *= 1 - p
            return np.concatenate([first, np.stack([np.ones(len(x)), x, x * x]) @ weight])

        def add(batch: pa.RecordBatch | None):
            if batch is None:
                return dict(enumerate(total))
            columns = _columns(batch)
            for s in range(0, batch.num_rows, CHUNK):
                total[:] += few(*(c[s : s + CHUNK] for c in columns))

        return add

    return make


def bootstrap_fits(
    df: DataFrame,
    successes: str,
    trials: str,
    x: str,
    replicates: int = 1000,
    seed: int = 7,
    parametric: bool = False,
    key: str | None = None,
    steps: int = 25,
    tol: float = 1e-9,
) -> np.ndarray:
    """Coefficients (2 x replicates) of a logit on ``x``, refitted to each replicate by Newton steps from the full fit.

    A replicate weighs whole rows by Poisson(1) numbers, or, if ``parametric``,
    draws every row's successes anew from the full fit.  ``key`` is a whole
    number that names a row, so that results do not depend on partitions; without
    one rows are numbered as they are written.  Nulls and rows without trials
    take no part.  One pass sums the gradients' expansions around the full fit;
    if these leave out less than ``tol`` of every coefficient's scale, that is all.
    Else Newton steps follow, each of which reads the rows once, until no
    replicate moves by more than ``tol`` of its scale, or for ``steps`` if one is
    separated.  The driver gets a few numbers per replicate.
    """
    full = fit_binomial(df, successes, trials, [x]).coef
    spark = df.sparkSession
    named = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(successes).cast("double").alias("won"), F.col(trials).cast("double").alias("n"), named.alias("key"))
    path = scratch_path(spark, "bootstrap")
    rows.na.drop().where("n > 0").write.parquet(path)
    kept = spark.read.parquet(path)
    known = kept.agg(F.avg("x").alias("centre"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    centre = known["centre"]
    scale = max(known["high"] - centre, centre - known["low"]) or 1.0
    found = array_sums(kept, _bootstrap_moments(full, centre, scale, replicates, seed, parametric))
    moments = np.stack([found[i] for i in range(len(found))])
    move, error = _expanded_fits(moments[:2], moments[2:], 1.0)
    start = np.stack([full[0] + move[0] - move[1] * centre / scale, full[1] + move[1] / scale])
    error = np.stack([error[0] + error[1] * abs(centre) / scale, error[1] / scale])
    if np.all(error <= tol * (1 + np.abs(start))):
        return start
    won = np.stack([moments[0], moments[1] * scale + moments[0] * centre])
    # replicates far from the full fit start there
    beta = np.where(np.all(error <= 1e-3, axis=0), start, full[:, None])
    sums = partial(_bootstrap_sums, replicates=replicates, seed=seed, parametric=parametric)
    for _ in range(steps):
        found = array_sums(kept, sums(beta))
        expected, (a, b, c) = np.stack([found[0], found[1]]), (found[2], found[3], found[4])
        g, h = won - expected
        det = a * c - b * b
        move = np.stack([c * g - b * h, a * h - b * g]) / np.where(det > 0, det, np.inf)
        beta = beta + move
        if np.all(np.abs(move) <= tol * (1 + np.abs(beta))):
            break
    return beta


def bootstrap_ci(
    df: DataFrame,
    successes: str,
    trials: str,
    x: str,
    at: Sequence[float],
    replicates: int = 1000,
    seed: int = 7,
    parametric: bool = False,
    key: str | None = None,
) -> DataFrame:
    """5 % and 95 % quantiles of the fitted probability at given x over resampled refits (``bootstrap_fits``)."""
    beta = bootstrap_fits(df, successes, trials, x, replicates, seed, parametric, key)
    rows = []
    for v in at:
        p = 1 / (1 + np.exp(-(beta[0] + beta[1] * v)))
        low, high = np.quantile(p, [0.05, 0.95])
        rows.append((float(v), replicates, float(low), float(high)))
    return df.sparkSession.createDataFrame(rows, "x double, replicates long, lower double, upper double")
