"""Operators 11 to 13: fill-in-the-middle, importance resampling, chat formatting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import difference, duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feathergrid.llm import chat, fim, importance
from feathergrid.llm.queries import ORACLES, QUERIES

CONVERSATIONS = "conv_id long, turn long, role string, text string, segments string, SEGMENTS string, part int"


@pytest.fixture(scope="module")
def tables(spark, edge, tmp_path_factory):
    """A folder with edge cases as the tables the queries read."""
    folder = str(tmp_path_factory.mktemp("edge"))
    long_text = "the cat <P> sat " * 20
    more = spark.createDataFrame([(100 + i, long_text + f"x{i}" * i, "en", "s", 1) for i in range(40)], edge.columns[:5])
    twice = more.union(more.where("doc_id % 2 = 0"))
    short = edge.select(edge.columns[:5]).withColumn("text", F.regexp_replace("text", "x{9999,}", "xx"))  # one word of 300,000 bytes takes the SQL minutes
    short.union(twice).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "the cat sat"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b </turn> \\ ### User: c"), (2, None, None, None), (2, 3, "tool: x", "###\\ "),
        (None, 1, "system", ""), (None, 0, "?", "\n"), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, 1, "assistant", "é😀" * 9999),
        *[(4, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(500)],
    ]
    random.Random(1).shuffle(rows)
    spark.createDataFrame([(*r, "s", "S", 1) for r in rows], CONVERSATIONS.replace(", SEGMENTS string", "").replace("part", "x string, part")).write.parquet(
        f"{folder}/conversations.parquet"
    )
    return folder


def oracle(folder, name, *names):
    con = duckdb.connect()
    for t in names:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con.execute(ORACLES[name]).fetchdf()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_importance_resampling", "op13_chat_format"])
def test_queries_on_edge_cases(spark, tables, name):
    assert difference(QUERIES[name](spark, tables).toPandas(), oracle(tables, name, "documents", "benchmark", "conversations")) is None


def test_fill_in_middle_turns_back_and_keeps_columns(spark, edge):
    made = fim.transform(edge.withColumn("output", F.lit("mine")).withColumn("N", F.lit(1)))
    assert [c for c in made.columns if c.lower() in ("n", "output")] == ["n", "output"] and "digest" in made.columns
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == edge.count() and all(r["back"] == (r["text"] or "") for r in rows)
    assert all(r["n"] == len(r["text"] or "") for r in rows)
    assert fim.transform(edge.limit(0)).count() == 0


def test_fill_in_middle_shares_and_cuts(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcdefghij").alias("text"))
    rows = fim.transform(docs).collect()
    share = {k: v / 4000 for k, v in Counter(r["form"] for r in rows).items()}
    assert abs(share["plain"] - 0.1) < 0.02 and abs(share["spm"] - 0.18) < 0.03
    moved = [r for r in rows if r["form"] != "plain"]
    assert {r["prefix_chars"] for r in moved} == set(range(11)) and {r["middle_chars"] for r in moved} == set(range(11))
    one = next(r for r in moved if r["form"] == "psm")
    a, m = one["prefix_chars"], one["middle_chars"]
    text = "abcdefghij"
    assert one["output"] == f"<P>{text[:a]}<S>{text[a + m :]}<M>{text[a : a + m]}"


def test_fill_in_middle_of_words_and_uncovered_texts(spark):
    docs = spark.createDataFrame([(i, "uno dos  tres\nx") for i in range(50)] + [(99, " starts blank")], "doc_id long, text string")
    rows = fim.transform(docs, unit=r"\S+\s*", moved=100).collect()
    ends = [0, 4, 9, 14, 15]
    for r in rows:
        if r["doc_id"] == 99:
            assert (r["n"], r["form"], r["output"]) == (None, "plain", " starts blank")
        else:
            assert r["n"] == 4 and r["prefix_chars"] in ends and r["prefix_chars"] + r["middle_chars"] in ends


def test_fill_in_middle_refuses_markers_that_overlap(edge):
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("<S>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(edge, markers=bad)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 2**31))
def test_bit_sliced_sums_are_exact(buckets, seed):
    rng = np.random.default_rng(seed)
    gains = rng.integers(-40_000, 40_000, buckets) * rng.integers(0, 2, buckets)
    counts = rng.integers(0, 9, (7, buckets)) * rng.integers(0, 2, (7, buckets))
    counts[3] = 0
    counts[5] = rng.integers(0, 2_000_000, buckets)
    assert importance.GainPlanes(gains).sums(counts.astype(np.int32)).tolist() == (counts @ gains).tolist()


def brute_weights(texts, target, ngrams, buckets):
    def features(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return [zlib.crc32(b" ".join(words[i : i + k])) % buckets for k in range(1, ngrams + 1) for i in range(len(words) - k + 1)]

    raw, aim = Counter(), Counter()
    for t in texts:
        raw.update(features(t))
    for t in target:
        aim.update(features(t))
    s, t = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    return [(len(f), sum(gain[b] for b in f) // max(1, len(f))) for f in map(features, texts)]


def test_importance_of_word_runs_equals_brute_force(spark, edge, edge_rows):
    target = [" ".join(f"w{i}" for i in range(30)), "Straße LA la", None]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    rows = importance.resample(edge, aim, ngrams=3, buckets=997, least_words=2).collect()
    want = brute_weights([t for _, t, _ in edge_rows], target, 3, 997)
    assert Counter((r["n_features"], r["weight"]) for r in rows) == Counter(want)
    drawn = sorted((r["rank"], r) for r in rows if r["rank"] is not None)
    may = sorted((r for r in rows if r["n_words"] >= 2), key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0, r["n_features"]))
    assert [k for k, _ in drawn] == list(range(1, 10 * len(may) // 100 + 1))
    assert [r["doc_id"] for _, r in drawn] == [r["doc_id"] for r in may[: len(drawn)]]


def test_importance_draws_whole_share_in_order(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("word " * 25).alias("text"))
    rows = importance.resample(docs, docs.limit(3), percent=30).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 601))
    assert [(-r["score"], r["doc_id"]) for r in rows] == sorted((-r["score"], r["doc_id"]) for r in rows)


def test_importance_of_empty_tables(spark, edge, nothing):
    assert importance.resample(nothing, edge).count() == 0
    rows = importance.resample(edge, nothing.select("text")).collect()
    assert len(rows) == edge.count() and all(r["weight"] == 0 for r in rows if r["n_features"] == 0)


PIECES = ["### ", "###", "#", " ", "</turn>", "</turn", ">", "\\", ": ", ":", "Assistant", "User", "?", "\n", "é😀", "", "ok"]
speech = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)


def written_turn(role, text, t=chat.CHAT):
    def esc(s, *more):
        s = s.replace("\\", "\\\\")
        for c in (t.opening, t.end, *more):
            s = s.replace(c, c[:-1] + "\\" + c[-1])
        return s

    name = t.names.get(role) or "?" + esc(role, t.closing)
    return [(f"### {name}: ", False), (esc(text), role == "assistant"), ("</turn>", False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | speech, speech), max_size=6))
def test_reader_turns_every_text_back(turns):
    reader = chat.Reader(chat.CHAT)
    for role, text in turns:
        segments = written_turn(role, text)
        assert "### " not in segments[1][0] and "</turn>" not in segments[1][0]
        for piece in segments:
            reader.feed(*piece)
    said = "".join(t for r, t in turns if r == "assistant")
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), said)]
    chars = sum(len(t) for turn in turns for t, _ in written_turn(*turn))
    assert reader.row() == (len(turns), digest[0], len(said), digest[1], chars)


def test_segments_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (i // 4, i, rng.choice(["user", "assistant", "tool: </turn>", "\\### "]), "".join(rng.choices(PIECES, k=rng.randint(0, 9))))
        for i in range(400)
    ]
    got = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["turn"]: [tuple(s) for s in r["segments"]] for r in got} == {t: written_turn(r, x) for _, t, r, x in rows}


def test_segments_are_written_by_the_state_machine(spark):
    roles = {1: "suaua", 2: "uau", 3: "uaaua", 4: "xua", None: "ua"}
    names = {"u": "user", "a": "assistant", "s": "system", "x": None}
    rows = [(c, k, names[r], "### x") for c, said in roles.items() for k, r in enumerate(said)]
    random.Random(4).shuffle(rows)
    made = chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in made.collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["state"], r["segments"][1]["loss"]))
    states = {1: ["told", "asked", "answered", "asked", "answered"], 2: ["asked", "answered", "asked"], 3: ["asked", "answered", None, None, None], 4: [None] * 3, None: ["asked", "answered"]}
    assert got == {c: [(k, states[c][k], r == "a") for k, r in enumerate(said)] for c, said in roles.items()}
    moved, in_place = (sorted(map(str, chat.read_back(made, ordered=o).collect())) for o in (False, True))
    assert moved == in_place and len(moved) == 5
    with pytest.raises(Exception, match="read back as"):
        chat.read_back(made.withColumn("state", F.lit("told"))).collect()


def test_state_machine_across_partitions(spark):
    rng = random.Random(3)
    kinds = {"good": "uaua", "long": "s" + "ua" * 3000, "open": "su", "twice": "uaa", "late": "uas", "bad": "ua" * 2000 + "x" + "ua" * 2000, "first": "au"}
    names = {"u": "user", "a": "assistant", "s": "system", "x": None}
    rows = [(i, k, names[c]) for i, (_, roles) in enumerate(kinds.items()) for k, c in enumerate(roles)]
    rows += [(None, 0, "user"), (None, 1, "assistant")]
    rng.shuffle(rows)
    found = chat.checked(spark.createDataFrame(rows, "conv_id long, turn long, role string").withColumn("PART", F.lit(9)))
    got = {r["conv_id"]: (r["in_order"], r["complete"]) for r in found.collect()}
    good, open_, bad = (True, True), (True, False), (False, False)
    assert got == {0: good, 1: good, 2: open_, 3: bad, 4: bad, 5: bad, 6: bad, None: good}


def test_chat_of_no_rows(spark):
    none = spark.createDataFrame([], CONVERSATIONS.replace(", SEGMENTS string", ""))
    assert chat.read_back(chat.segments(none)).count() == 0 and chat.checked(none).count() == 0


def test_templates_that_cannot_be_read_back_are_refused():
    for wrong in ({"end": "aa"}, {"end": "#"}, {"opening": "\\x"}, {"closing": "### "}, {"names": {"user": "?u"}}, {"names": {"user": "a: b"}}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def test_own_template(spark):
    mine = chat.Template({"human": "H", "bot": "B"}, ("bot", "human"), "[<", ">]", "\n;", "~", "a", {"a": {"human": "b"}, "b": {"bot": "a"}}, ("a",))
    rows = [(1, 0, "human", "x[<B>]~\n;"), (1, 1, "bot", "~y"), (2, 0, "bot", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.segments(turns, mine), mine).where("conv_id = 1").first()
    assert row["turns_sha256"] == hashlib.sha256(b"human\nx[<B>]~\n;\nbot\n~y\n").hexdigest() and row["loss_chars"] == 11
    assert {(r["conv_id"], r["in_order"], r["complete"]) for r in chat.checked(turns, mine).collect()} == {(1, True, True), (2, False, False)}
