"""Exact and near-duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from feathergrid.llm import exact_dedup, near_dedup, substring_dedup
from feathergrid.llm.common import mix, written

LAST = 1 << 63


def _order(i):
    return LAST if i is None else i


def _digest(text):
    return hashlib.sha256(re.sub("[ \t-\r]+", " ", text or "").encode()).hexdigest()


def test_exact_decisions_equal_brute_force(edge, edge_rows):
    got = exact_dedup.DigestIndex(edge.sparkSession).add(edge).collect()
    assert len(got) == len(edge_rows)
    groups = {}
    for i, text, _ in edge_rows:
        groups.setdefault(_digest(text), []).append(i)
    kept = {}
    for r in got:
        mine = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(mine, key=_order), len(mine))
        kept.setdefault(r.text_sha256, []).append(r.doc_id) if r.kept else None
    assert {d: [min(g, key=_order)] for d, g in groups.items()} == kept


def test_exact_index_remembers_earlier_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(5, "a b"), (6, "c")], schema)
    second = spark.createDataFrame([(1, "a  b"), (2, "d"), (3, "d")], schema)
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.add(first).collect()} == {(5, 5, True), (6, 6, True)}
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.add(second).collect()} == {(1, 5, False), (2, 2, True), (3, 2, False)}
    reopened = exact_dedup.DigestIndex(spark, index.path, buckets=3)
    assert reopened.table().count() == 3
    third = spark.createDataFrame([(0, "c"), (9, "new")], schema)
    assert {r.doc_id for r in exact_dedup.drop_copies(third, reopened).collect()} == {9}


def test_exact_lookup_reads_the_index_by_bucket(spark):
    """The new digests are exchanged, the index is not: it is bucketed by digest."""
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(spark.createDataFrame([(5, "a b")], "doc_id long, text string")).collect()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = spark.createDataFrame([("x",)], "digest string").repartition(4, "digest")
        plan = new.join(index.table().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_exact_drop_keeps_columns_and_empty_table(edge, nothing, edge_rows):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert kept.count() == len({_digest(t) for _, t, _ in edge_rows})
    assert exact_dedup.drop_copies(nothing).count() == 0


def _shingles(text):
    words = (text or "").encode().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else None


def _classes(rows, similarity=0.8):
    """Row numbers by class, comparing all pairs."""
    sets = [_shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), set()).add(i)
    return {frozenset(s) for s in out.values()}


def _documents(seed=3):
    """Random texts, chains of small edits around the threshold, and one large group of near copies."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 7)):
            texts.append(" ".join(words))
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(500)}"
    base = [f"v{i}" for i in range(200)]
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(200)] = f"u{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_near_classes_equal_all_pairs(spark):
    texts = _documents()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(3)
    got = {}
    rows = near_dedup.near_duplicates(docs).collect()
    for r in rows:
        got.setdefault(r.class_id, set()).add(r.doc_id)
        assert r.kept == (r.doc_id == r.class_id)
    want = _classes(texts)
    assert {frozenset(s) for s in got.values()} == want
    assert all(min(s) == k for k, s in got.items())
    assert all(r.class_size == len(got[r.class_id]) for r in rows)


def test_near_edges(edge, nothing, edge_rows):
    rows = near_dedup.near_duplicates(edge).collect()
    texts = [t for _, t, _ in edge_rows]
    sizes = sorted(len(s) for s in _classes(texts))
    assert len(rows) == len(texts) and sum(r.kept for r in rows) == len(sizes)
    assert sorted(r.class_size for r in rows if r.kept) == sizes
    kept = near_dedup.drop_near_copies(edge)
    assert kept.columns == edge.columns and kept.count() == len(sizes)
    assert near_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("size", [3, 50, 3000])
def test_signature_agrees_as_often_as_the_sets(size):
    rng = np.random.default_rng(size)
    pool = rng.integers(0, 1 << 63, size * 5 // 4 + 1, dtype=np.uint64)
    a, b = pool[:size], pool[len(pool) - size :]
    jaccard = len(set(a) & set(b)) / len(set(a) | set(b))
    same = [
        (near_dedup.signature(mix(a + np.uint64(k)), np.ones(size)) == near_dedup.signature(mix(b + np.uint64(k)), np.ones(size))).mean()
        for k in range(30)
    ]
    assert abs(np.mean(same) - jaccard) < 0.04


def test_signature_of_weighted_sets():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    v, w = rng.uniform(0.1, 4, 40), rng.uniform(0.1, 4, 40)
    jaccard = np.minimum(v, w).sum() / np.maximum(v, w).sum()
    same = [(near_dedup.signature(mix(x + np.uint64(k)), v) == near_dedup.signature(mix(x + np.uint64(k)), w)).mean() for k in range(40)]
    assert abs(np.mean(same) - jaccard) < 0.03


def test_near_weighted_counts_occurrences(spark):
    once, often = "a b c d e f", "a b c d e f " * 4
    docs = spark.createDataFrame([(1, often + "x"), (2, often + "x"), (3, once)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, weighted=True).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def _cut(rows, window):
    """Kept words per row, by looking at every window of every row."""
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, LAST), _order(i))
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        keep = [True] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < _order(i):
                keep[k : k + window] = [False] * window
        kept = b" ".join(w for w, x in zip(words, keep) if x)
        out.append((i, len(words), len(words) - sum(keep), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            a = rng.randrange(0, 250)
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = passage[a : a + rng.randrange(30, 120)]
        if i % 7 == 0:
            words += ["go"] * rng.randrange(40, 160)
        if i % 9 == 0:
            words += ["ping", "pong"] * rng.randrange(20, 80)
        rows.append((rng.choice([i, i, i // 2, None]), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs, with_text=True).collect()]
    assert sorted(got, key=str) == _cut(rows, 50)


def test_repeats_edges(edge, nothing, edge_rows):
    got = sorted([tuple(r) for r in substring_dedup.remove_repeats(edge).collect()], key=str)
    assert got == [r[:4] for r in _cut([(i, t) for i, t, _ in edge_rows], 50)]
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 30, 4000).astype(np.uint64)
    hashes[2500:2700] = hashes[100:300]
    mixed = mix(hashes)
    first, last, anchor = substring_dedup.ranges(mixed, np.zeros(len(mixed), dtype=bool))
    offset = np.repeat(anchor, last - first + 1) - np.arange(len(mixed) - 49)
    assert (offset[100:251] == offset[2500:2651]).all()
    assert (offset >= 10).all() and (offset <= 40).all()


def roughly_alike(n, words=60, changed=6, seed=9):
    """Copies of one text, each with a few words of its own: some pairs reach the threshold, most do not."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    texts = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(0, changed)):
            own[at] = f"o{k}_{at}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("chunk", [near_dedup.CHUNK_ELEMENTS, 3000])
def test_near_classes_of_a_large_rough_group(spark, monkeypatch, chunk):
    """All pairs that reach the similarity are connected, whatever the size of the chunks."""
    monkeypatch.setattr(near_dedup, "CHUNK_ELEMENTS", chunk)
    texts = roughly_alike(300) + roughly_alike(5, seed=3, words=45)
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "rough")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert got == {i: top(i) for i in range(len(texts))}
    assert 5 < len(set(got.values())) < 300


def test_a_repeated_batch_decides_as_the_first_time(spark):
    docs = written(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "c")], "doc_id long, text string").coalesce(1), "batch")
    later = written(spark.createDataFrame([(9, "b"), (10, "new")], "doc_id long, text string").coalesce(1), "later")
    index = exact_dedup.DigestIndex(spark)
    tables = {t.name for t in spark.catalog.listTables()}

    def decided(rows, batch):
        return sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in index.add(rows, batch).collect()), key=str)

    first = decided(docs, "monday")
    assert [x[3] for x in first].count(True) == 3
    assert decided(docs, "monday") == first  # the job is repeated
    assert decided(later, "tuesday") == [(10, 10, 1, True), (9, 3, 1, False)]
    assert decided(later, "tuesday") == [(10, 10, 1, True), (9, 3, 1, False)] and decided(docs, "monday") == first
    assert not any(x[3] for x in decided(docs, "wednesday"))
    assert exact_dedup.drop_copies(docs, index, "monday").count() == 3
    index.close()
    assert len({t.name for t in spark.catalog.listTables()}) == len(tables) - 1
