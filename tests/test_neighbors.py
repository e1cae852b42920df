"""Exact nearest neighbours against all pairs, and what the search leaves out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from feathergrid.ml import neighbors as N
from feathergrid.session import table


def brute(train, test, k):
    out = {}
    for i, q in test:
        d = [(float(np.sqrt(((np.array(q) - np.array(v)) ** 2).sum())), j) for j, v in train]
        out[i] = [j for _, j in sorted(d)[:k]]
    return out


def searched(spark, train, test, k, **more):
    t = spark.createDataFrame([(i, v, 1.0) for i, v in train], "id long, v array<double>, label double")
    q = spark.createDataFrame(test, "id long, v array<double>")
    out = {}
    for r in N.knn(t, q, "id", "v", "label", k, **more).orderBy("id", "pick").collect():
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


@pytest.mark.parametrize("pieces", [10_000, 40])
def test_equals_all_pairs(spark, pieces):
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 6, (8, 12))
    rows = [(i, (middle[i % 8] + rng.normal(size=12)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # one vector in a fifth of the rows
    test = [(5000 + i, (middle[i % 9 % 8] + rng.normal(size=12)).tolist()) for i in range(60)] + [(9, rows[5][1])]
    assert searched(spark, rows, test, 7, piece_rows=pieces) == brute(rows, test, 7)


def test_few_rows_and_lengths_far_apart(spark):
    rows = [(1, [0.0, 0.0]), (2, [1e6, 0.0]), (3, [0.0, 1e-6]), (4, [0.0, 0.0])]
    test = [(7, [0.0, 0.0]), (8, [1e6, 1.0])]
    assert searched(spark, rows, test, 3) == brute(rows, test, 3)
    assert searched(spark, rows, test, 9) == brute(rows, test, 9)
    assert searched(spark, [], test, 3) == {} and searched(spark, rows, [], 3) == {}
    nulls = spark.createDataFrame([(1, None, 1.0), (2, [1.0], 0.0)], "id long, v array<double>, label double")
    assert [tuple(r)[:2] for r in N.knn(nulls, nulls, "id", "v", "label", 1).collect()] == [(2, 2)]


def left_out(spark, train, test, key, vector, label, k):
    counters = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    N.knn(train, test, key, vector, label, k, counters=counters).count()
    return 1 - counters[1].value / (train.count() * test.count())


def test_over_half_of_the_given_pairs_are_left_out(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    even, odd = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")
    assert left_out(spark, even, odd, "vec_id", "embedding", "label", 9) > 0.5


def test_clusters_leave_out_nearly_all_pairs(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(0, 9, (40, 16))
    rows = [(i, (middle[i % 40] + rng.normal(size=16)).tolist(), 0.0) for i in range(8000)]
    t = spark.createDataFrame(rows, "id long, v array<double>, label double")
    assert left_out(spark, t, t.where(F.col("id") % 20 == 0), "id", "v", "label", 5) > 0.9


def test_a_block_returns_k_pairs_a_query_however_many_it_scores():
    rng = np.random.default_rng(3)
    t, q = rng.normal(size=(900, 6)), rng.normal(size=(300, 6))
    t[500:] = t[0]  # copies tie
    block = N._Block(4, t.mean(axis=0), np.eye(6))
    row, col, distance = block.nearest(q, t, np.full(len(q), np.inf))
    assert len(row) == 4 * len(q)
    full = np.sqrt(((q[:, None] - t) ** 2).sum(2))
    want = np.argsort(full, axis=1, kind="stable")[:, :4]
    for i in range(len(q)):
        assert sorted(col[row == i]) == sorted(want[i])
