"""Nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform)
turns a vector's direction; its hash is the signed axis nearest to it, with
several functions the tuple of their axes.  Vectors of similar length form a
shell, in which the largest products are near the smallest angles.  Every vector
of a large shell lies in one bucket of each table; a query looks into the buckets
of its nearest axes in each such shell, and at all vectors of small shells.
Queries and candidates of a bucket meet in blocks, where exact products choose
the best; the blocks' best are merged.  Equal vectors are hashed and compared once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own_names, written

NEAREST = 20
TABLES = 8
#: Axes per function that a query looks at; in proportion more if there are over AXES, whatever the number of vectors.
#: Directions alone are hashed: of unequal lengths, or of few vectors, the best may lie at wide angles, hence so many.
PROBES = 20
AXES = 128
#: Hash functions per table; two are for some 10^7 vectors and more.
FUNCTIONS = 1
#: Vectors of either side in one block; a fuller bucket is split.
BLOCK = 8000
SEED = 20


def rotations(dim: int, tables: int, functions: int, seed: int = SEED) -> np.ndarray:
    """Random signs: tables x functions x 3 rounds x padded dimension."""
    padded = 1 << max(0, (dim - 1).bit_length())
    return np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0]), (tables, functions, 3, padded))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n = x.shape[1]
    h = 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(-1, n) / np.sqrt(n)


def turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows after the pseudo-rotation, as products with all signed axes."""
    y = np.zeros((len(x), signs.shape[1]))
    y[:, : x.shape[1]] = x
    for round_signs in signs:
        y = hadamard(y * round_signs)
    return np.hstack([y, -y])


def buckets(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """Rows x probes^functions bucket numbers of one table, the nearest bucket first."""
    axes = 2 * signs.shape[-1]
    tops = []
    for function in signs:
        near = turned(x, function)
        tops.append(np.argsort(-near, axis=1, kind="stable")[:, : min(probes, axes)] if probes > 1 else near.argmax(axis=1)[:, None])
    out = []
    for choice in itertools.product(*[range(t.shape[1]) for t in tops]):
        number = np.zeros(len(x), dtype=np.int64)
        for k, c in enumerate(choice):
            number = number * axes + tops[k][:, c]
        out.append(number)
    return np.stack(out, axis=1)


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that take part; rows of one id with equal vectors once."""
    v = F.col("v")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = own_names(vectors, key, vector).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("id IS NOT NULL").where(v.isNotNull() & (F.size(v) > 0) & finite & F.exists("v", lambda x: x != 0)).distinct()


def _hashed(classes: DataFrame, dims: list[int], tables: int, functions: int, probes: int | None) -> DataFrame:
    """``key, rep, v`` of candidates (no ``probes``) for each table, or of queries for each place they look at."""
    place = {d: i for i, d in enumerate(dims)}
    signs = {d: rotations(d, tables, functions) for d in dims}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, lists = np.array(batch.column(0)), batch.column(1)
            sizes = np.array(lists.value_lengths())
            for d in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == d)
                looked = 1 if probes is None else max(probes, -(-2 * signs[d].shape[-1] * probes // AXES))
                at = pa.array(mine)
                ids, vectors = pa.array(reps[mine], pa.int64()), lists.take(at)
                x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(mine), d)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                for t in range(tables):
                    found = buckets(x, signs[d][t], looked)
                    for p in range(found.shape[1]):
                        key = (found[:, p] * tables + t) * len(dims) + place[d]
                        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), ids, vectors], names=["key", "rep", "v"])

    return classes.select("rep", "v").mapInArrow(run, "key long, rep long, v array<double>")


def _best(queries: pa.Table, candidates: pa.Table, keep: int) -> pa.Table:
    """The ``keep`` best candidate classes of each query in a block, with exact products."""
    schema = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
    if not queries.num_rows or not candidates.num_rows:
        return schema.empty_table()

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = table.column("v").combine_chunks()
        return np.array(table.column("rep")), np.asarray(v.flatten()).reshape(len(v), -1)

    q_rep, q = matrix(queries)
    c_rep, c = matrix(candidates)
    out = []
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        rough = part @ c.T
        k = min(len(c), keep + 8)  # a few more, as a product of matrices may round differently
        near = np.argpartition(-rough, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(rough, near, axis=1).min(axis=1) - 1e-9
        for i in range(len(part)):
            mine = near[i] if k == len(c) else np.flatnonzero(rough[i] >= edge[i])
            score = (c[mine] * part[i]).sum(axis=1)
            order = np.lexsort((c_rep[mine], -score))[:keep]
            out.append((np.full(len(order), q_rep[a + i]), c_rep[mine][order], score[order]))
    return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)


def _blocks(queries: DataFrame, candidates: DataFrame, keep: int) -> DataFrame:
    """Best classes per query and block of buckets; full buckets are split on both sides."""
    sizes_q = queries.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nq"))
    sizes_c = candidates.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nc"))
    sizes = written(sizes_q.join(sizes_c, "key"), "bucket-sizes")

    def split(side: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        placed = side.join(sizes, "key").withColumn(mine, F.pmod(F.xxhash64("rep"), F.col(own)).cast("int"))
        return placed.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("key", "a", "b", "rep", "v")

    left, right = split(queries, "nq", "nc", "a", "b"), split(candidates, "nc", "nq", "b", "a")

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        return _best(q, c, keep)

    grouped = left.groupBy("key", "a", "b").cogroup(right.groupBy("key", "a", "b"))
    return grouped.applyInArrow(meet, "query long, rep long, score double")


def search(
    vectors: DataFrame,
    is_query,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
    tables: int = TABLES,
    probes: int = PROBES,
    functions: int = FUNCTIONS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the rows with the largest inner products for each query row.

    ``is_query`` is a condition on the column ``id``.  All rows with another id
    are candidates.  Vectors that are null, empty or zero or hold null or
    non-finite components take no part, nor do null ids; rows of one id with
    equal vectors count once; vectors of different lengths never meet.  Scores
    are products in double precision on the given vectors, ties go to the
    smaller id.  A query that finds fewer than ``nearest`` in its buckets is
    compared with all vectors, in blocks.
    """
    spark = vectors.sparkSession
    rows = written(_usable(vectors, key, vector), "vectors")
    classes = rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.max(F.when(is_query, 1).otherwise(0)).alias("asks"))
    classes = written(classes, "vector-classes")
    dims = sorted(r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect())  # a row per dimension
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = classes.where("asks = 1")
    # An id with several vectors is a candidate by each; of its own class a query needs one more.
    members = rows.join(classes.select("v", "rep"), "v").select("rep", "id")
    first = Window.partitionBy("rep").orderBy("id")
    listed = members.withColumn("k", F.row_number().over(first)).where(F.col("k") <= nearest + 1).drop("k")
    listed = written(listed, "class-members")
    queries = written(members.where(is_query).select(F.col("rep").alias("query"), F.col("id").alias("query_id")), "queries")

    candidates = written(_hashed(classes, dims, tables, functions, None), "buckets")
    probing = written(_hashed(asking, dims, tables, functions, probes), "probes")
    near = _blocks(probing, candidates, nearest + 1)
    top = written(_top(near, nearest + 1), "nearest-classes")

    # Queries that met too few others look at everything of their length.
    found = top.join(classes.select("rep", "n"), "rep").groupBy("query").agg(F.sum("n").alias("met"))
    whole = classes.groupBy(F.size("v").alias("d")).agg(F.sum("n").alias("all"))
    short = asking.join(found, F.col("rep") == F.col("query"), "left").join(whole, F.size("v") == F.col("d"))
    short = written(short.where(F.coalesce("met", F.lit(0)) < F.least(F.col("all"), F.lit(nearest + 1))).select("rep", "v"), "short")
    everything = classes.join(short.select(F.size("v").alias("d")).distinct(), F.size("v") == F.col("d"), "left_semi")
    rest = _blocks(_all(short), _all(everything), nearest + 1)
    top = top.join(short.select(F.col("rep").alias("query")), "query", "left_anti").union(_top(rest, nearest + 1))

    pairs = queries.join(top, "query").join(listed, "rep").where("id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    pairs = pairs.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return pairs.where(F.col("rank") <= nearest).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _all(classes: DataFrame) -> DataFrame:
    return classes.select(F.size("v").cast("long").alias("key"), "rep", "v")


def _top(near: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return near.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= keep).drop("k")
