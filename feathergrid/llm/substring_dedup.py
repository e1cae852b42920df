"""Removal of repeated passages, found by recompression.

Recompression names runs of equal tokens and then pairs of tokens by hashes,
round after round, so each name stands for one word sequence and equal
sequences get the same names inside, wherever they occur: a token goes into
the left or the right part of a pair according to a bit of its own name, hence
pairs never overlap and a name depends only on the words it covers and on the
few neighbours that were looked at.  How far that reaches is tracked per symbol.

After ``ROUNDS`` rounds, every window of ``WINDOW`` words takes as its anchor
the symbol with the least hash among those that begin in its middle and depend
on nothing outside it.  Equal windows therefore have the same anchor at the same
place.  Neighbouring windows with one anchor form a range.  Spark counts, per
anchor with ``REACH`` words to either side, in how many documents it occurs;
only ranges whose anchor is shared go on.  Ranges that are equal as a whole are
settled at once, map-side first; of each distinct one only the first
document's windows are named and compared with those of other ranges.  Windows
without an anchor (long runs of one word) are ranges of one window, so nothing
is left out.  A window's name is 128 bits of two rolling hashes over its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, fresh_name, mix, words_of, written

WINDOW = 50
ROUNDS = 3
REACH = 10

#: Up to this many wanted documents (a long each) are told to all executors; more are joined by a shuffle.
SMALL_ROWS = 500_000

_LAST = (1 << 63) - 1  # stands for a null doc_id: later than all others
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_MASK = (1 << 64) - 1


class Rolling:
    """Names of word ranges: two polynomials modulo 2^64 over mixed 64-bit word hashes."""

    def __init__(self, hashes: np.ndarray):
        self.sums, self.inverse = [], []
        n = len(hashes)
        for k, base in enumerate(_BASES):
            power = _powers(base, n + 1)
            term = mix(hashes + np.uint64(k + 1)) * power[:n]
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)]))
            self.inverse.append(_powers(pow(base, -1, 1 << 64), n + 1))

    def name(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        length = (end - start).astype(np.uint64)
        return [mix((s[end] - s[start]) * i[start] + length) for s, i in zip(self.sums, self.inverse)]


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base & _MASK, dtype=np.uint64), dtype=np.uint64)])
        if size <= 1 << 20:
            _POWERS[base] = held
    return held[:n]


def recompress(hashes: np.ndarray, fence: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """``(name, start, left, right)`` of the symbols after the rounds: first word, and the words ``[left, right)`` each depends on.

    ``fence`` marks places between documents; a fence joins nothing.
    """
    name = hashes.copy()
    start = np.arange(len(hashes))
    left, right = start.copy(), start + 1
    for level in range(rounds):
        if len(name) < 2:
            break
        # Runs of equal symbols become one; a symbol's extent in a run hangs on both neighbours.
        new = np.concatenate([[True], name[1:] != name[:-1]])
        head = np.flatnonzero(new)
        count = np.diff(np.concatenate([head, [len(name)]]))
        tail = head + count - 1
        left, right = _with_neighbours(left[head], right[tail], head, tail, left, right)
        name = np.where(count > 1, mix(name[head] + np.uint64(2 * level + 1) * mix(count.astype(np.uint64))), name[head])
        start, fence = start[head], fence[head]
        if len(name) < 2:
            break
        # Pairs: a symbol of the left part followed by one of the right part.
        is_left = (mix(name + np.uint64(1000 + level)) & np.uint64(1)).astype(bool)
        joins = is_left[:-1] & ~is_left[1:] & ~fence[:-1] & ~fence[1:]
        head = np.flatnonzero(np.concatenate([[True], ~joins]))  # a symbol that closes a pair begins nothing
        paired = np.concatenate([joins, [False]])[head]
        tail = head + paired
        # A pair hangs on its parts alone; a single left symbol also on its successor, a single right one on its predecessor.
        left, right = _with_neighbours(left[head], right[tail], head, tail, left, right, ~paired & ~is_left[head], ~paired & is_left[head])
        name = np.where(paired, mix(name[head] * np.uint64(3) + mix(name[tail]) + np.uint64(2 * level + 2)), name[head])
        start, fence = start[head], fence[head]
    return name, start, left, right


def _with_neighbours(low, high, head, tail, left, right, before=True, after=True):
    """Widen what symbols depend on by the neighbours that were looked at; at a document's end by one word beyond it."""
    low, high = low.copy(), high.copy()
    for looked, at, missing in ((before, head - 1, -1), (after, tail + 1, len(left))):
        use = np.flatnonzero(np.broadcast_to(looked, head.shape) & (at != missing))
        low[use] = np.minimum(low[use], left[at[use]])
        high[use] = np.maximum(high[use], right[at[use]])
    low[np.broadcast_to(before, head.shape) & (head == 0)] -= 1
    high[np.broadcast_to(after, head.shape) & (tail == len(left) - 1)] += 1
    return low, high


def ranges(hashes: np.ndarray, fence: np.ndarray, window: int = WINDOW, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first, last, anchor)``: runs of window starts with the same anchor word, in order; anchor -1 for none.

    Windows lie within documents, between fences.  What hangs on a fence or an
    end is no anchor for them, as it would have to lie in the window.
    """
    n = len(hashes) - window + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    name, start, left, right = recompress(hashes, fence)
    fit = (start - left <= reach) & (right - start <= reach)
    rank = np.full(len(hashes), np.iinfo(np.uint64).max, dtype=np.uint64)
    rank[start[fit]] = mix(name[fit]) >> np.uint64(1)
    width = window - 2 * reach + 1
    best = _sliding_argmin(rank[reach : reach + n + width - 1], width) + reach
    best[rank[best] == np.iinfo(np.uint64).max] = -1
    fences = np.concatenate([[0], np.cumsum(fence)])
    inside = fences[window:] == fences[:-window]
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (best[1:] < 0) | (inside[1:] != inside[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [n]]) - 1
    use = inside[first]
    return first[use], last[use], best[first[use]]


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the first of equals) in every stretch of ``width``, by doubling."""
    place = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        have += step
    return place


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_RANGE = pa.struct([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _ranges_of(docs: list[np.ndarray], window: int) -> pa.Array:
    """A list per document of its ranges with their keys and names; the documents are worked on together."""
    lengths = np.array([len(d) for d in docs])
    starts = np.cumsum(lengths + 1) - lengths - 1
    hashes = np.zeros(int((lengths + 1).sum()), dtype=np.uint64)
    fence = np.zeros(len(hashes), dtype=bool)
    fence[starts + lengths] = True
    hashes[fence] = mix(np.arange(len(docs), dtype=np.uint64) + np.uint64(1 << 62))  # fences differ, so they form no run
    for d, a in zip(docs, starts):
        hashes[a : a + len(d)] = d
    first, last, anchor = ranges(hashes, fence, window)
    rolling = Rolling(hashes)
    a, b = rolling.name(first, last + window)
    middle = anchor >= 0
    low, high = np.where(middle, anchor - REACH, first), np.where(middle, anchor + REACH, first + window)
    key = rolling.name(low, high)[0]
    doc = np.searchsorted(starts, first, side="right") - 1
    columns = (key, a, b, first - starts[doc], last - starts[doc])
    found = pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in columns], fields=list(_RANGE))
    offsets = np.searchsorted(doc, np.arange(len(docs) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), found)


def _portions(texts: pa.Array, most: int = 64_000) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of the texts, in portions of about ``most`` words, with the place of each portion's first text."""
    held, words = [], 0
    for i, text in enumerate(texts):
        held.append(words_of(text.as_py()))
        words += len(held[-1])
        if words >= most:
            yield i + 1 - len(held), held
            held, words = [], 0
    if held:
        yield len(texts) - len(held), held


def _surveyed(placed: DataFrame, row: str, window: int) -> DataFrame:
    """Per document its id, order, number of words, digest of all words and ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for at, docs in _portions(batch.column(2)):
                part = batch.slice(at, len(docs))
                found = _ranges_of([known.of(words) for words in docs], window)
                counts, digests = pa.array([len(w) for w in docs], pa.int64()), pa.array([_digest(w) for w in docs])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), counts, digests, found], names=[row, "doc_id", "n", "digest", "ranges"]
                )

    schema = f"{row} long, doc_id long, n long, digest string, ranges array<struct<key:long,a:long,b:long,first:long,last:long>>"
    return placed.mapInArrow(run, schema)


def _texts_of(placed: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (by row) with the texts; only the wanted texts are moved."""
    keys = wanted.select(row)
    few = keys.count() <= SMALL_ROWS
    return placed.select(row, "text").join(F.broadcast(keys) if few else keys, row, "left_semi").join(wanted, row)


def _windows(texts: DataFrame, row: str, window: int) -> DataFrame:
    """``row, ord, start, a, b``: the names of the windows that begin in the given spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            column = batch.schema.names.index
            for i in range(batch.num_rows):
                words = words_of(batch.column(column("text"))[i].as_py())
                _unchanged(words, batch.column(column("digest"))[i].as_py())
                rolling = Rolling(known.of(words))
                spans = batch.column(column("spans"))[i].as_py()
                start = np.concatenate([np.arange(x["start"], x["end"]) for x in spans])
                a, b = rolling.name(start, start + window)
                same = [pa.array(np.full(len(start), batch.column(column(c))[i].as_py(), dtype=np.int64)) for c in (row, "ord")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(start), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=[row, "ord", "start", "a", "b"]
                )

    return texts.mapInArrow(run, f"{row} long, ord long, start long, a long, b long")


def _unchanged(words: list[bytes], digest: str) -> None:
    if _digest(words) != digest:
        raise ValueError("the documents read differently the second time; write them to a table first")


def remove_repeats(documents: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) of every document.

    Words are the runs of anything but ASCII white space.  A word is removed if
    a window of ``window`` words that covers it also starts in a document with a
    smaller ``doc_id``; windows are judged on the texts as given.  A null id is
    later than all others.  Rows with one id do not remove from each other.
    Null texts have no words, and texts shorter than a window lose none.
    ``documents`` must be a table that reads the same each time; if it is not,
    the job stops.
    """
    if window < 2 * REACH + 1:
        raise ValueError("the window is too short for its anchor")
    row = fresh_name(documents, "row")
    placed = documents.select(F.monotonically_increasing_id().alias(row), "doc_id", "text")
    survey = written(_surveyed(placed, row, window), "survey")
    order = F.coalesce("doc_id", F.lit(_LAST)).alias("ord")

    # Only ranges whose anchor occurs in two documents can hold a window of two.
    spans = survey.select(row, order, F.explode("ranges").alias("r")).select(row, "ord", "r.*")
    common = spans.groupBy("key").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("key")
    common = spans.join(written(common, "common-anchors"), "key")
    common = written(common, "common-ranges")

    # A range that a smaller id holds as a whole goes as a whole.
    least = written(common.groupBy("key", "a", "b").agg(F.min("ord").alias("lo")), "least")
    ranked = common.join(least, ["key", "a", "b"])
    gone = ranked.where("ord > lo").select(row, F.col("first").alias("start"), (F.col("last") + window).alias("end"))

    # Ranges that differ around one anchor may still share windows: name those, for the first id of each range.
    varied = written(least.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "varied")
    open_spans = ranked.where("ord = lo").join(varied, "key").select(row, "ord", F.col("first").alias("start"), (F.col("last") + 1).alias("end"))
    asked = open_spans.groupBy(row, "ord").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    asked = written(asked.join(survey.select(row, "digest"), row), "asked")
    named = written(_windows(_texts_of(placed, row, asked), row, window), "windows")
    lowest = written(named.groupBy("a", "b").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("a", "b", "lo"), "lowest")
    single = named.join(lowest, ["a", "b"]).where("ord > lo").select(row, "start", (F.col("start") + window).alias("end"))

    cuts = gone.union(single).groupBy(row).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cuts = written(cuts.join(survey.select(row, "digest"), row), "cuts")
    cut = written(_cut(_texts_of(placed, row, cuts), row, with_text), "cut")
    out = survey.select(row, "doc_id", "n", "digest").join(cut, row, "left").select(
        row,
        "doc_id",
        F.col("n").alias("n_words"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
        *(["kept_text"] if with_text else []),
    )
    if with_text:  # untouched documents: their words as they are
        plain = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != ""), " ")
        out = out.join(placed.select(row, plain.alias("all_text")), row).withColumn("kept_text", F.coalesce("kept_text", "all_text"))
        out = out.drop("all_text")
    return out.drop(row)


def _cut(texts: DataFrame, row: str, with_text: bool) -> DataFrame:
    """The words outside the spans of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.names.index
            out = []
            for i in range(batch.num_rows):
                words = words_of(batch.column(column("text"))[i].as_py())
                _unchanged(words, batch.column(column("digest"))[i].as_py())
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                spans = batch.column(column("spans"))[i]
                np.add.at(edge, spans.values.field("start").to_numpy(), 1)
                np.add.at(edge, spans.values.field("end").to_numpy(), -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = [w for w, k in zip(words, keep) if k]
                text = b" ".join(kept)
                made = (batch.column(column(row))[i].as_py(), len(words) - len(kept), hashlib.sha256(text).hexdigest())
                out.append(made + ((text.decode("utf-8", "surrogatepass"),) if with_text else ()))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 if with_text else 3]
            names = [row, "n_removed", "kept_sha256", "kept_text"][: len(types)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return texts.mapInArrow(run, f"{row} long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
