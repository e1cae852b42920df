"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from feathergrid.llm import ann


def _exact(rows, query, nearest=20):
    """``rows``: distinct (id, vector); best score per candidate id over the query id's vectors."""
    best = {}
    for i, v in rows:
        for j, w in rows:
            if i == query and j != query and len(v) == len(w):
                best[j] = max(best.get(j, -np.inf), float((np.array(v) * np.array(w)).sum()))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:nearest]


def _search(frame, condition, **options):
    got = {}
    for r in ann.search(frame, condition, **options).collect():
        got.setdefault(r.query_id, []).append(r)
    for rows in got.values():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    return got


def test_few_vectors_are_found_exactly(spark):
    """On few vectors all buckets are looked into: lengths that differ, ties, copies and broken rows."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6) * (1 + i % 5))]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(7, rows[7][1])] + [(9, rows[20][1])]
    broken = [(300, None), (320, [0.0] * 6), (340, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (360, [float("nan")] + [1.0] * 5), (380, [float("inf")] * 6), (None, rows[0][1]), (400, [])]
    other = [(420, [1.0, 2.0]), (421, [3.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + broken + other], "vec_id long, embedding array<float>, rep string").coalesce(3)
    got = _search(frame, F.col("id") % 20 == 0)
    usable = [(i, tuple(v)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows + other)]
    assert set(got) == {i for i, _ in usable if i % 20 == 0}
    for query, found in got.items():
        want = _exact(usable, query)
        assert [r.vec_id for r in found] == [i for i, _ in want]
        assert np.allclose([r.score for r in found], [s for _, s in want], rtol=0, atol=1e-12)
    assert ann.search(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_recall_and_short_queries(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 32))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    frame = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = _search(frame, F.col("id") % 50 == 0)
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({r.vec_id for r in found} & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 80 and hits / (80 * 20) >= 0.9


@pytest.mark.parametrize("sigma, longest", [(0.0, 5.0), (0.1, 1.0)])
def test_recall_on_unequal_lengths(spark, tmp_path, sigma, longest):
    """More vectors than any shell searched whole: one long vector, or lengths that spread."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30_000, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x *= np.exp(rng.normal(size=(len(x), 1)) * sigma)
    x[7] *= longest
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))}), tmp_path / "vectors.parquet")
    got = _search(spark.read.parquet(str(tmp_path / "vectors.parquet")), F.col("id") % 200 == 0)
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({r.vec_id for r in found} & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 150 and hits / (150 * 20) >= 0.95


@pytest.mark.parametrize("n, sigma", [(1200, 0.0), (9000, 0.0), (1200, 0.6)])
def test_one_rule_at_every_size(spark, n, sigma):
    """A query finds exactly what lies in the buckets it looks into, however few the vectors are."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 64))
    x *= np.exp(rng.normal(size=(n, 1)) * sigma) / np.sqrt((x * x).sum(axis=1, keepdims=True))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = _search(frame, F.col("id") % 300 == 0)
    u, hits = x / np.sqrt((x * x).sum(axis=1, keepdims=True)), 0
    signs = ann.rotations(64, ann.TABLES, ann.FUNCTIONS)
    own = [ann.buckets(u, s, 1)[:, 0] for s in signs]
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        met = np.zeros(n, dtype=bool)
        for t, s in enumerate(signs):
            met |= np.isin(own[t], ann.buckets(u[[q]], s, ann.PROBES)[0])
        assert {r.vec_id for r in found} == set(np.argsort(-np.where(met, score, -np.inf))[:20].tolist())
        hits += len({r.vec_id for r in found} & set(np.argsort(-score)[:20].tolist()))
    assert 0.9 <= hits / (20 * len(got))


def test_full_buckets_are_split(spark, monkeypatch):
    """Blocks of a few rows give the same result, so a bucket may hold any share of the rows."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in np.array([5.0, 0, 0, 0]) + rng.normal(size=4) * 0.01]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BLOCK", 16)
    got = _search(frame, F.col("id") % 30 == 0, nearest=5)
    for query, found in got.items():
        assert [r.vec_id for r in found] == [i for i, _ in _exact([(i, tuple(v)) for i, v in rows], query, 5)]


def test_rotation_keeps_products():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 13))
    signs = ann.rotations(13, 1, 1)[0, 0]
    near = ann.turned(x, signs)[:, : signs.shape[1]]
    assert np.allclose(near @ near.T, x @ x.T)
