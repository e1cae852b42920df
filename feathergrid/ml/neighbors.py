"""Exact k nearest neighbours without comparing all pairs.

Training rows lie in cells around pivot rows.  Every query is first really
scored against its nearest cell; the k-th distance found there bounds what can
still matter.  Cells whose ring of distances, or whose border with the query's
own cell, is farther than that are skipped.  Inside a cell pairs are compared
along the principal axes, the leading quarter first: the squared distance on
the axes so far plus the squared difference of what is left of both lengths is a
lower bound, pairs above the bound drop out, and the pairs with the smallest
lower bounds are scored at once to tighten it.  Only pairs that survive all
levels are scored in full, by plain differences, so equal vectors tie exactly.

A big cell is split into pieces, a crowd of queries into lanes; a task holds one
piece and one lane.  The driver holds the pivots, whose number grows with the
square root of the training rows, and one matrix of axes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feathergrid.operators.blocks import array_sums, matrix
from feathergrid.operators.rows import sample_n, top_k_per_group
from feathergrid.session import scratch_path

# rows of one piece: bounds the memory of one block of pairs
PIECE_ROWS = 4096
# queries compared at a time, and pairs scored at a time
QUERY_ROWS, PAIR_ROWS = 256, 65_536
# shares of the axes after which pairs may drop out
LEVELS = (0.25, 0.5, 0.75, 0.875)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def principal_axes(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and orthonormal axes by falling variance, from one aggregate of d x d sums."""

    def make():
        sums: dict[int, np.ndarray] = {}

        def add(batch: pa.RecordBatch | None):
            if batch is None:
                return {0: sums[0].ravel()} if sums else {}
            v = matrix(batch.column(0))
            full = np.column_stack([np.ones(len(v)), v])
            sums[0] = sums.get(0, 0) + full.T @ full

        return add

    total = array_sums(rows.select(vector), make).get(0)
    if total is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int(round(len(total) ** 0.5))
    total = total.reshape(d, d)
    n, mean = int(total[0, 0]), total[0, 1:] / total[0, 0]
    _, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return n, mean, axes[:, ::-1]


class _Block:
    """The nearest rows of one piece to a few queries."""

    def __init__(self, k: int, mean: np.ndarray, axes: np.ndarray):
        self.k, self.mean, self.axes = k, mean, axes
        self.cuts = sorted({max(1, int(len(mean) * s)) for s in LEVELS})
        self.pairs = self.scored = 0

    def _score(self, q: np.ndarray, t: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for s in range(0, len(row), PAIR_ROWS):
            gap = q[row[s : s + PAIR_ROWS]] - t[col[s : s + PAIR_ROWS]]
            out[s : s + PAIR_ROWS] = np.sqrt((gap * gap).sum(1))
        self.scored += len(row)
        return out

    def nearest(self, q: np.ndarray, t: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query and row numbers and distances of the k nearest rows of each query among those that can matter, ties to the earlier row."""
        turned = (t - self.mean) @ self.axes
        rest = [np.sqrt((turned[:, p:] ** 2).sum(1)) for p in self.cuts]
        parts = [self._few(q[s : s + QUERY_ROWS], t, turned, rest, bound[s : s + QUERY_ROWS], s) for s in range(0, len(q), QUERY_ROWS)]
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _few(self, q, t, turned, rest, bound, first):
        self.pairs += len(q) * len(t)
        mine = (q - self.mean) @ self.axes
        slack = 1e-9 * (1 + (mine * mine).sum(1) + (turned * turned).sum(1).max())  # rounding of the products
        limit = bound * bound + slack
        alive = np.ones((len(q), len(t)), bool)
        known = np.full((len(q), len(t)), np.nan)  # distances scored so far
        partial, before, width = 0.0, 0, min(self.k, len(t))
        for p, left in zip(self.cuts, rest, strict=True):
            partial = partial + _squares(mine[:, before:p], turned[:, before:p])
            before = p
            low = partial + (np.sqrt((mine[:, p:] ** 2).sum(1))[:, None] - left) ** 2
            alive &= low <= limit[:, None]
            if not alive.any():
                break
            best = np.argpartition(np.where(alive, low, np.inf), width - 1, axis=1)[:, :width]
            row, col = np.repeat(np.arange(len(q)), width), best.ravel()
            new = np.isnan(known[row, col]) & alive[row, col]
            known[row[new], col[new]] = self._score(q, t, row[new], col[new])
            if width == self.k:
                kth = np.sort(known, axis=1)[:, self.k - 1]  # nan sorts last
                limit = np.fmin(limit, kth * kth + slack)
                alive &= low <= limit[:, None]
        row, col = np.nonzero(alive & np.isnan(known))
        known[row, col] = self._score(q, t, row, col)
        row, col = np.nonzero(self._closest(known))
        return row + first, col, known[row, col]

    def _closest(self, known: np.ndarray) -> np.ndarray:
        """Which of the scored pairs are a query's k smallest; few pairs leave a block, however many were scored."""
        scored = ~np.isnan(known)
        if known.shape[1] <= self.k:
            return scored
        known = np.where(scored, known, np.inf)
        kth = np.partition(known, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        under, tied = known < kth, (known == kth) & scored
        room = self.k - under.sum(axis=1)[:, None]
        return under | tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= room)


def knn(
    train: DataFrame,
    test: DataFrame,
    key: str,
    vector: str,
    label: str,
    k: int,
    pivots: int | None = None,
    piece_rows: int = PIECE_ROWS,
    counters: tuple[Accumulator, Accumulator] | None = None,
) -> DataFrame:
    """``(key, neighbour, label, distance, pick)``: the k nearest training rows of each test row, ties to the smaller key.

    Rows without a vector take no part; fewer than k training rows are all
    returned.  ``counters`` take the number of pairs and of those scored in full.
    """
    spark = train.sparkSession
    vec = F.col(vector).cast("array<double>")
    schema = "id long, v array<double>, label double, cell int, near double"
    known = train.where(F.col(vector).isNotNull())
    rows = known.select(F.col(key).alias("id"), vec.alias("v"), F.col(label).cast("double").alias("label"))
    queries = test.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), vec.alias("v"))
    n, mean, axes = principal_axes(rows, "v")
    if not n:
        return spark.createDataFrame([], f"{key} long, neighbour long, label double, distance double, pick int")
    pivots = min(n, pivots or max(2, int(n**0.5 / 8)))
    centres = _stack(sample_n(rows.select("id", "v"), ["id"], pivots, seed=1).toPandas()["v"])
    between = np.sqrt(_squares(centres, centres))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = np.sqrt(_squares(_stack(pdf["v"]), centres))
                yield pdf.assign(cell=d.argmin(1), near=d.min(1))

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    placed = kept(rows.mapInPandas(place, schema), "knn-rows")
    asked = kept(queries.withColumn("label", F.lit(None).cast("double")).mapInPandas(place, schema), "knn-queries")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("lo"), F.max("near").alias("hi"))
    size, low, high = np.zeros(pivots, np.int64), np.full(pivots, np.inf), np.full(pivots, -np.inf)
    for r in stats.collect():  # one row per pivot
        size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["lo"], r["hi"]

    def compared(probes: DataFrame) -> DataFrame:
        """The k best of each (query, piece) for ``probes(id, v, cell, bound)``."""
        load = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        shape = [(c, max(1, -(-int(size[c]) // piece_rows)), max(1, -(-load[c] // piece_rows))) for c in sorted(load)]
        split = spark.createDataFrame(shape, "cell int, pieces int, lanes int")
        each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
        wide = F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane")
        lane = F.pmod(F.xxhash64("id"), F.col("lanes")).cast("int").alias("lane")
        piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece")
        left = probes.join(split, "cell").select("id", "v", "bound", "cell", lane, each)
        right = placed.join(split, "cell").select("id", "v", "label", "cell", piece, wide)

        def closest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(t):
                return pd.DataFrame({"id": [], "neighbour": [], "label": [], "distance": []})
            t = t.sort_values("id")
            block = _Block(k, mean, axes)
            row, col, distance = block.nearest(_stack(q["v"]), _stack(t["v"]), q["bound"].fillna(np.inf).to_numpy())
            if counters is not None:
                counters[0].add(block.pairs)
                counters[1].add(block.scored)
            ids = t["id"].to_numpy()
            found = pd.DataFrame({"id": q["id"].to_numpy()[row], "neighbour": ids[col], "label": t["label"].to_numpy()[col], "distance": distance})
            found = found.sort_values(["id", "distance", "neighbour"])
            return found[found.groupby("id").cumcount() < k]

        on = ["cell", "piece", "lane"]
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(
            closest, "id long, neighbour long, label double, distance double"
        )

    def best(found: DataFrame) -> DataFrame:
        return top_k_per_group(found.withColumn("_closeness", -F.col("distance")), ["id"], "neighbour", "_closeness", k)

    unbounded = asked.select("id", "v", "cell", F.lit(None).cast("double").alias("bound"))
    own = kept(compared(unbounded), "knn-own")
    kth = best(own).where(F.col("pick") == k).select("id", F.col("distance").alias("bound"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query's other cells that may hold a nearer row."""
        for pdf in batches:
            if not len(pdf):
                continue
            v, own = _stack(pdf["v"]), pdf["cell"].to_numpy()
            square = _squares(v, centres)
            d, here = np.sqrt(square), square[np.arange(len(v)), own]
            # own cell has less than k rows: enough other cells always hold k rows within d + high
            order = np.argsort(d + high, axis=1)
            enough = np.minimum((np.cumsum(size[order], axis=1) < k).sum(1), pivots - 1)
            reach = np.take_along_axis(d + high, order, axis=1)[np.arange(len(v)), enough]
            reach = np.where(size.sum() < k, np.inf, reach)
            bound = np.fmin(pdf["bound"].to_numpy(dtype=float), reach)
            gap = between[own]
            border = np.divide(square - here[:, None], 2 * gap, out=np.zeros_like(gap), where=gap > 0)
            floor = np.maximum(np.maximum(d - high, low - d), border)
            slack = 1e-9 * (1 + bound + d.max())
            near = (floor <= (bound + slack)[:, None]) & (size > 0)
            near[np.arange(len(v)), own] = False
            rows, cells = np.nonzero(near)
            # a query may have as many probes as there are cells: a few pieces' worth at a time
            for s in range(0, len(rows), PIECE_ROWS):
                row = rows[s : s + PIECE_ROWS]
                yield pd.DataFrame(
                    {"id": pdf["id"].to_numpy()[row], "v": pdf["v"].to_numpy()[row], "bound": bound[row], "cell": cells[s : s + PIECE_ROWS]}
                )

    bounded = asked.select("id", "v", "cell").join(kth, "id", "left")
    probes = bounded.mapInPandas(others, "id long, v array<double>, bound double, cell int")
    found = own.unionByName(compared(kept(probes, "knn-probes")))
    return best(found).select(F.col("id").alias(key), "neighbour", "label", "distance", "pick")


def knn_classify(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, ks: Sequence[int]) -> DataFrame:
    """``(key, k, prediction)``: majority vote of the k nearest for every k, from one search; equal votes go to the smallest label."""
    near = knn(train, test, key, vector, label, max(ks))
    each = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("pick") <= F.col("k"))
    votes = each.groupBy(key, "k", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(key, "k").agg(F.max(F.struct("votes", (-F.col("label")).alias("neg"))).alias("b"))
    return best.select(key, "k", (-F.col("b.neg")).alias("prediction"))
