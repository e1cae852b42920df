"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word (a run of letters, lowercase) is embedded as the mean of the hashed
vectors of itself and its stems (its first few letters), so that inflected forms
share what was learned.  Filters of several widths slide over the text
and each keeps its maximum; a logistic layer scores the maxima.  The model is
trained in numpy on a bounded sample of labelled texts.  A threshold per
language, set on a part of the sample that training leaves out, is mapped to
0.5.  The language for that is voted by function words of the text itself, so
only the text decides.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, bounded_sample, own_names

#: Labelled texts per class that training reads at most; a quarter of them sets the thresholds.
SAMPLE_PER_CLASS = 2500
BUCKETS = 1 << 16
DIM = 8
FILTERS = 6
WIDTHS = (1, 3, 6)
STEMS = (3, 4, 5, 6, 7)
EPOCHS = 4
#: Fewer calibration texts of either class than this: the language takes the common threshold.
LEAST_FOR_LANGUAGE = 12

#: Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as are on this be by at from have not",
    "fr": "le la les des et est un une du que qui dans pour pas sur avec en au plus par",
    "de": "der die das und ist nicht ein eine zu den mit von dem auf sich im als auch es für",
    "es": "el los las del y es una por con para no se lo como más al pero sus ha su",
}

_PAD = 0
_BATCH_WORDS = 100_000
_KNOWN_WORDS = 250_000  # words a task knows before it starts anew
_KNOWN_CHUNKS = 400_000
_letters = regex.compile(r"\p{L}+").findall


def parts_of(word: str) -> list[int]:
    """The buckets of a word and of its stems."""
    raw = word.encode("utf-8", "surrogatepass")
    return [1 + zlib.crc32(raw) % (BUCKETS - 1)] + [
        1 + zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), 1) % (BUCKETS - 1) for n in STEMS if n <= len(word)
    ]


class Words:
    """Numbers for words, 0 for padding; ``parts`` and ``votes`` (whose function word it is) of the words from ``base`` on."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.chunks: dict[str, bytes] = {"": b""}
        self.base = 0
        self.parts: list[list[int]] = [[_PAD]]
        self.votes: list[int] = [-1]
        self.voters = {w: k for k, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}

    def _learn(self, chunk: str) -> bytes:
        out = []
        for word in _letters(chunk.lower()):
            if word not in self.number:
                self.number[word] = self.base + len(self.parts)
                self.parts.append(parts_of(word))
                self.votes.append(self.voters.get(word, -1))
            out.append(self.number[word].to_bytes(4, "little"))
        value = self.chunks[chunk] = b"".join(out)
        return value

    def of(self, text: str | None) -> np.ndarray:
        chunks = (text or "").split()
        known = self.chunks
        return np.frombuffer(b"".join([known[c] if c in known else self._learn(c) for c in chunks]), dtype=np.uint32)

    @property
    def full(self) -> bool:
        return len(self.number) > _KNOWN_WORDS or len(self.chunks) > _KNOWN_CHUNKS

    def forget(self) -> None:
        """Drop parts and votes of the words so far; their numbers stay."""
        self.base += len(self.parts)
        self.parts, self.votes = [], []

    def means(self, table: np.ndarray) -> np.ndarray:
        """The mean of the table's rows of each word's parts, for the words from ``base`` on."""
        some = self.parts
        counts = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        out = np.empty((len(some), table.shape[1]), dtype=np.float32)
        for a in range(0, len(some), 4096):
            b = min(a + 4096, len(some))
            flat = np.fromiter((p for x in some[a:b] for p in x), dtype=np.int64, count=int(counts[a:b].sum()))
            first = np.cumsum(counts[a:b]) - counts[a:b]
            out[a:b] = np.add.reduceat(table[flat], first, axis=0) / counts[a:b, None]
        return out


@dataclass
class ToxicModel:
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(FUNCTION_WORDS) + 1, 0.5))

    def table(self) -> np.ndarray:
        """Per part what it adds to each filter at each of its places, so that scoring only gathers and adds."""
        return np.hstack([self.embedding @ w[k] for w in self.filters for k in range(len(w))]).astype(np.float32)


class Scorer:
    """Scores texts with a model; long texts go through in pieces that overlap by a filter's width."""

    def __init__(self, model: ToxicModel):
        self.model, self.by_part = model, model.table()
        self._fresh()

    def _fresh(self) -> None:
        self.words = Words()
        self.table = np.empty((1 << 12, self.by_part.shape[1]), dtype=np.float32)
        self.votes = np.empty(1 << 12, dtype=np.int8)
        self._take_in()

    def _take_in(self) -> None:
        a, b = self.words.base, self.words.base + len(self.words.parts)
        if a == b:
            return
        if b > len(self.table):
            size = max(b, 2 * len(self.table))
            self.table, old = np.empty((size, self.table.shape[1]), dtype=np.float32), self.table
            self.votes, voted = np.empty(size, dtype=np.int8), self.votes
            self.table[:a], self.votes[:a] = old[:a], voted[:a]
        self.table[a:b] = self.words.means(self.by_part)
        self.votes[a:b] = self.words.votes
        self.words.forget()

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.words.full:
            self._fresh()
        docs = [self.words.of(t) for t in texts]
        self._take_in()
        return docs

    def maxima(self, docs: list[np.ndarray]) -> np.ndarray:
        """Each filter's maximum over each text; a window of padding, value 0, is part of every text."""
        found = np.zeros((len(docs), FILTERS * len(WIDTHS)), dtype=np.float32)
        pad = np.zeros(max(WIDTHS) - 1, dtype=np.uint32)
        parts, owner, length = [], [], 0
        step = _BATCH_WORDS
        for i, ids in enumerate(docs):
            for start in range(0, len(ids), step):
                parts.append(np.concatenate([ids[start : start + step + len(pad)], pad]))
                owner.append(i)
                length += len(parts[-1])
                if length >= step:
                    self._flush(parts, owner, found)
                    parts, owner, length = [], [], 0
        self._flush(parts, owner, found)
        return found

    def _flush(self, parts: list[np.ndarray], owner: list[int], found: np.ndarray) -> None:
        if not parts:
            return
        ids = np.concatenate(parts)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        rows, at = self.table[ids], 0
        inside = (ids != _PAD)[:, None]
        for k, width in enumerate(WIDTHS):
            value = rows[:, at * FILTERS : (at + 1) * FILTERS].copy()
            for j in range(1, width):
                value[:-j] += rows[j:, (at + j) * FILTERS : (at + j + 1) * FILTERS]
            at += width
            value *= inside  # windows that begin in padding count as padding
            best = np.maximum.reduceat(value, starts, axis=0)
            np.maximum.at(found[:, k * FILTERS : (k + 1) * FILTERS], owner, best)

    def raw(self, docs: list[np.ndarray]) -> np.ndarray:
        hidden = np.maximum(self.maxima(docs) + self.model.bias, 0.0)
        logit = (hidden * self.model.out).sum(axis=1, dtype=np.float64) + self.model.out_bias
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))

    def language(self, docs: list[np.ndarray]) -> np.ndarray:
        """Index into FUNCTION_WORDS of the language with most votes; one more for none."""
        n = len(FUNCTION_WORDS)
        out = np.full(len(docs), n)
        for i, ids in enumerate(docs):
            votes = self.votes[ids]
            votes = np.bincount(votes[votes >= 0], minlength=n)
            if votes.sum():
                out[i] = votes.argmax()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        docs = self.read(texts)
        score, limit = self.raw(docs), self.model.thresholds[self.language(docs)]
        low = score < limit
        with np.errstate(divide="ignore", invalid="ignore"):
            mapped = np.where(low, 0.5 * score / limit, 0.5 + 0.5 * (score - limit) / (1.0 - limit))
        return np.clip(np.where(low, np.minimum(mapped, 0.5 - 1e-9), mapped), 0.0, 1.0)


def train(docs: list[np.ndarray], labels: np.ndarray, words: Words, seed: int = 7) -> ToxicModel:
    """Logistic loss, classes weighted alike, Adam on filters and output, Adagrad on the part vectors that were met."""
    counts = np.fromiter(map(len, words.parts), dtype=np.int64, count=len(words.parts))
    first_part = np.cumsum(counts) - counts
    flat_parts = np.fromiter((p for x in words.parts for p in x), dtype=np.int64, count=int(counts.sum()))

    def spans(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of these words in a row, and where each word's begin."""
        n = counts[which]
        begin = np.cumsum(n) - n
        return flat_parts[np.repeat(first_part[which] - begin, n) + np.arange(n.sum())], begin

    rng = np.random.default_rng(seed)
    width_sum = FILTERS * len(WIDTHS)
    model = ToxicModel(
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(width_sum, dtype=np.float32),
        rng.normal(0, 0.3, width_sum).astype(np.float32),
        0.0,
    )
    model.embedding[_PAD] = 0.0
    seen = np.zeros((BUCKETS, 1), dtype=np.float32)
    dense = [*model.filters, model.bias, model.out, np.zeros(1, dtype=np.float32)]
    first, second = [np.zeros_like(x) for x in dense], [np.zeros_like(x) for x in dense]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    pad = np.zeros(max(WIDTHS) - 1, dtype=np.uint32)
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            ids = np.concatenate([np.concatenate([docs[i], pad]) for i in some])
            ends = np.cumsum([len(docs[i]) + len(pad) for i in some])
            met, place_of = np.unique(ids, return_inverse=True)
            pieces, begin = spans(met)
            emb = (np.add.reduceat(model.embedding[pieces], begin, axis=0) / counts[met, None])[place_of].astype(np.float32)
            hidden, places = np.zeros((len(some), width_sum), dtype=np.float32), np.zeros((len(some), width_sum), dtype=np.int64)
            for k, w in enumerate(WIDTHS):
                value = emb @ model.filters[k][0]
                for j in range(1, w):
                    value[:-j] += emb[j:] @ model.filters[k][j]
                value[ids == _PAD] = 0.0
                for r, end in enumerate(ends):
                    start = end - len(pad) - len(docs[some[r]])
                    best = value[start:end].argmax(axis=0)
                    places[r, k * FILTERS : (k + 1) * FILTERS] = best + start
                    hidden[r, k * FILTERS : (k + 1) * FILTERS] = value[start + best, np.arange(FILTERS)]
            act = np.maximum(hidden + model.bias, 0.0)
            logit = act @ model.out + dense[-1][0]
            error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[some]) * weight[some] / len(some)).astype(np.float32)
            back = error[:, None] * model.out[None, :] * (act > 0)
            grads = [np.zeros_like(x) for x in dense]
            grads[-1][0], grads[-2], grads[-3] = error.sum(), act.T @ error, back.sum(axis=0)
            rows, steps = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                where, b = places[:, cols], back[:, cols] * (ids[places[:, cols]] != _PAD)
                for j in range(w):
                    place = np.minimum(where + j, len(ids) - 1)
                    vectors = emb[place]  # texts x filters x DIM
                    grads[k][j] = np.einsum("rfd,rf->df", vectors, b)
                    rows.append(ids[place].ravel())
                    steps.append((b[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIM))
            step += 1
            rate = 0.01 * (1 - 0.8 * epoch / EPOCHS)
            for x, g, m, v in zip(dense, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            changed, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            by_word = np.zeros((len(changed), DIM), dtype=np.float32)
            np.add.at(by_word, inverse, np.concatenate(steps))
            by_word /= counts[changed, None]
            pieces, _ = spans(changed)
            touched, inverse = np.unique(pieces, return_inverse=True)
            total = np.zeros((len(touched), DIM), dtype=np.float32)
            np.add.at(total, inverse, np.repeat(by_word, counts[changed], axis=0))
            total[touched == _PAD] = 0.0
            seen[touched] += (total**2).mean(axis=1, keepdims=True)
            model.embedding[touched] -= 0.1 * total / (np.sqrt(seen[touched]) + 1e-6)
    model.out_bias = float(dense[-1][0])
    return model


def _threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The cut between two neighbouring scores with the best F1; of equally good ones the middle."""
    order = np.argsort(-score, kind="stable")
    score, label = score[order], label[order]
    if len(score) < 2:
        return 0.5
    hits = np.cumsum(label == 1)[:-1]
    f1 = 2 * hits / (np.arange(1, len(score)) + max(1, (label == 1).sum()))
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    cuts = (score[good] + score[good + 1]) / 2
    return float(np.clip(np.median(cuts), 0.02, 0.98))


def fit_texts(texts: list[str], labels: list[int]) -> ToxicModel:
    """Train on three quarters of the texts in their order and set the thresholds on the rest."""
    words = Words()
    docs, truth = [words.of(t) for t in texts], np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:  # nothing to tell apart
        model = train(docs[:0], truth[:0], words)
        model.out[:] = 0.0
        model.out_bias = 5.0 if labels and labels[0] == 1 else -5.0
        return model
    aside = np.arange(len(docs)) % 4 == 3
    model = train([d for d, a in zip(docs, aside) if not a], truth[~aside], words)
    scorer = Scorer(model)
    held = scorer.read([t for t, a in zip(texts, aside) if a])
    score, lang, truth = scorer.raw(held), scorer.language(held), truth[aside]
    model.thresholds[:] = _threshold(score, truth)
    for k in range(len(model.thresholds)):
        mine = lang == k
        if min((truth[mine] == 1).sum(), (truth[mine] == 0).sum()) >= LEAST_FOR_LANGUAGE:
            model.thresholds[k] = _threshold(score[mine], truth[mine])
    return model


def fit(documents: DataFrame, labels: DataFrame) -> ToxicModel:
    """Train on ``documents`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1).

    At most about ``SAMPLE_PER_CLASS`` labels of each class are used, those with
    the smallest hash of ``doc_id``.  Null ids, labels and texts are no examples.
    """
    chosen = bounded_sample(own_names(labels, "doc_id", "toxic").where("toxic IN (0, 1)"), "doc_id", "toxic", SAMPLE_PER_CLASS)
    texts = own_names(documents, "doc_id", "text").where("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").limit(4 * SAMPLE_PER_CLASS).collect()  # the sample's size is bounded
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["text"], r["toxic"]))
    return fit_texts([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(documents: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Whole texts are read; a null text counts as empty, and texts without letters
    all get the model's score of an empty text.  Repeated rows score alike; an
    empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column(text).to_pylist()
            found = np.concatenate([scorer.scores(texts[i : i + 256]) for i in range(0, len(texts), 256)])
            return {"score": found, "predicted": (found >= 0.5).astype(np.int32)}

        return work

    return arrow_map(documents, make, RESULT, keep=True)
