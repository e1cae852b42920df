"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the share of character 1-, 2- and 3-grams that are
present in both (presence, not counts; cosine-normalised).  A Nyström map
through landmark texts turns it into finite features, and one-versus-rest
kernel ridge regression gives a score per language.  Scoring multiplies a
batch's presence matrix with the landmarks' matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, bounded_sample, own_names

#: Texts per language that training reads, and how many of them serve as landmarks.
SAMPLE_PER_LANG = 150
LANDMARKS_PER_LANG = 40
ORDERS = (1, 2, 3)
RIDGE = 1e-2
UNDETERMINED = "und"

_SLOTS = 18  # bits of the dictionary's hash table
_PIECE = 1 << 20  # characters handled at once
_ROWS = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: the code point if it is a letter, else a blank."""
    points = np.arange(0x110000, dtype=np.uint32)
    is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return np.where(is_letter, points, np.uint32(32))


def code_points(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _letters()[raw]


def _grams(points: np.ndarray, order: int) -> np.ndarray:
    """The n-grams at every position, exactly, as 21 bits per character."""
    codes = points[: len(points) - order + 1].astype(np.uint64)
    for k in range(1, order):
        codes |= points[k : len(points) - order + 1 + k].astype(np.uint64) << np.uint64(21 * k)
    return codes


class Dictionary:
    """The n-grams of the landmarks, found by one probe of a hash table.

    Two n-grams in one slot: the one more landmarks hold stays, the other is no feature.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        codes = codes[np.lexsort((codes, -counts))]
        slots, first = np.unique(self._slot(codes), return_index=True)
        self.codes = np.zeros(1 << _SLOTS, dtype=np.uint64)
        self.index = np.zeros(1 << _SLOTS, dtype=np.int64)
        self.codes[slots] = codes[first]
        self.index[slots] = np.arange(len(slots))
        self.size = len(slots)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def presence(self, texts: list[np.ndarray]) -> np.ndarray:
        """One row of 0/1 per text; a long text is read in overlapping pieces."""
        flags = np.zeros((len(texts), self.size), dtype=np.float32)
        for row, piece in _pieces(texts):
            points = np.concatenate(piece)
            rows = np.repeat(row, [len(p) for p in piece])
            for order in ORDERS:
                if len(points) < order:
                    continue
                codes = _grams(points, order)
                slot = self._slot(codes)
                hit = np.flatnonzero(self.codes[slot] == codes)
                flags[rows[hit], self.index[slot[hit]]] = 1.0
        return flags


def _pieces(texts: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    rows, parts, length = [], [], 0
    gap = np.full(max(ORDERS) - 1, (1 << 21) - 1, dtype=np.uint32)  # no character, so in no n-gram of the dictionary
    for i, text in enumerate(texts):
        for start in range(0, len(text), _PIECE):
            part = text[start : start + _PIECE + len(gap)]
            rows.append(i)
            parts.append(np.concatenate([part, gap]))
            length += len(part)
            if length >= _PIECE:
                yield rows, parts
                rows, parts, length = [], [], 0
    if parts:
        yield rows, parts


def _unit(flags: np.ndarray) -> np.ndarray:
    norm = np.sqrt(flags.sum(axis=1, keepdims=True))
    return flags / np.maximum(norm, 1.0)


@dataclass
class LangModel:
    langs: list[str]
    dictionary: Dictionary | None
    weights: np.ndarray | None  # dictionary x languages, or dictionary x landmarks before `out`
    out: np.ndarray | None

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        kernel = _unit(self.dictionary.presence(texts)) @ self.weights
        return kernel @ self.out[:-1] + self.out[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, values = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for at in range(0, len(texts) if self.langs else 0, _ROWS):  # code points of a few texts at a time
            points = {at + k: code_points(t) for k, t in enumerate(texts[at : at + _ROWS]) if t}
            some = [i for i, p in points.items() if (p != 32).any()]
            if not some:
                continue
            found = np.clip(self.scores([points[i] for i in some]), 1e-6, 1.0)
            best = found.argmax(axis=1)
            share = found[np.arange(len(some)), best] / found.sum(axis=1)
            for i, k, v in zip(some, best, share):
                langs[i], values[i] = self.langs[k], float(v)
        return langs, values


def fit_texts(texts: list[str], langs: list[str]) -> LangModel:
    """Train on a bounded sample of labelled texts."""
    points = [code_points(t or "") for t in texts]
    use = [i for i, p in enumerate(points) if (p != 32).any()]
    points, langs = [points[i] for i in use], [langs[i] for i in use]
    names = sorted(set(langs))
    if not names:
        return LangModel([], None, None, None)
    landmarks, taken = [], dict.fromkeys(names, 0)
    for i, lang in enumerate(langs):
        if taken[lang] < LANDMARKS_PER_LANG:
            taken[lang] += 1
            landmarks.append(i)
    held = [np.unique(np.concatenate([_grams(points[i], n) for n in ORDERS if len(points[i]) >= n])) for i in landmarks]
    codes, counts = np.unique(np.concatenate(held), return_counts=True)
    dictionary = Dictionary(codes, counts)
    marks = _unit(dictionary.presence([points[i] for i in landmarks]))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # the Nyström map: kernel values -> features
    kernel = np.vstack([_unit(dictionary.presence(points[i : i + _ROWS])) @ marks.T for i in range(0, len(points), _ROWS)])
    features = np.hstack([kernel.astype(np.float64) @ root, np.ones((len(points), 1))])
    target = (np.array(langs)[:, None] == np.array(names)[None, :]).astype(np.float64)
    weight = 1.0 / (target.sum(axis=0) @ target.T)  # each language weighs the same
    weighted = features * weight[:, None]
    ridge = RIDGE * np.eye(features.shape[1]) / len(names)
    ridge[-1, -1] = 0.0
    beta = np.linalg.solve(features.T @ weighted + ridge * len(names) / features.shape[1], weighted.T @ target)
    out = np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32)
    return LangModel(names, dictionary, np.ascontiguousarray(marks.T), out)


def fit(labelled: DataFrame) -> LangModel:
    """Train on ``text, lang`` of at most about ``SAMPLE_PER_LANG`` rows per language.

    The rows are those with the smallest hash of their ``doc_id``; rows with a
    null id, text or language are no examples.
    """
    rows = own_names(labelled, "doc_id", "text", "lang").where("text IS NOT NULL")
    sample = bounded_sample(rows, "doc_id", "lang", SAMPLE_PER_LANG).select("h", "lang", "text").collect()
    sample.sort(key=lambda r: (r["h"], r["lang"], r["text"]))
    return fit_texts([r["text"] for r in sample], [r["lang"] for r in sample])


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(documents: DataFrame, model: LangModel, text: str = "text", keep: bool = True) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``score`` (0 to 1).

    ``und`` with score 0 where the text is null, empty or without a letter, or
    when nothing could be learned.  Only the text decides; whole texts are read.
    Repeated rows get equal results; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            langs, values = fitted.predict(batch.column(text).to_pylist())
            return {"lang_pred": langs, "score": values}

        return work

    return arrow_map(documents, make, RESULT, keep=keep)


def keep_recognised(documents: DataFrame, model: LangModel) -> DataFrame:
    """The rows whose text has a recognised language, all columns unchanged.

    Rejected are null texts and texts without a letter, and no others: if the
    model has learned no language, the letters alone decide.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    target = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        where = [f.name for f in target.fields].index("text")
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(where).to_pylist()
                if fitted.langs:
                    keep = [x != UNDETERMINED for x in fitted.predict(texts)[0]]
                else:
                    keep = [bool((code_points(t or "") != 32).any()) for t in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, target)
