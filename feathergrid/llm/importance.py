"""Importance resampling towards a target corpus, with exact weights from bit-sliced sums.

Words and runs of words are hashed into buckets.  A bucket's gain says how much
commoner it is in the target than in the corpus.  A document's weight is the
mean gain of its features.  Its sum is taken bit-sliced: the document's bucket
counts become planes of one bit a bucket, the gains planes of one bit a bucket
and sign; the ones in the AND of two planes, times the power of two both stand
for, add up to the exact sum in integers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import dense_row_id
from .common import arrow_map, own_names, written

#: A-Z to a-z; digits, letters and all bytes of non-ASCII characters as they are; all else to a blank.
_FOLD = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()

#: Documents whose bucket counts are held at a time.
BLOCK = 64


class Features(dict):
    """Feature -> bucket for features already met; emptied when it gets large."""

    def __init__(self, buckets: int, ngrams: int, size: int = 400_000):
        super().__init__()
        self.buckets, self.ngrams, self.size = buckets, ngrams, size

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.size:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.buckets
        return value

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words of a text, and the buckets of all its runs of 1 to ``ngrams`` words."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        found = [np.fromiter(map(self.__getitem__, words), np.int32, len(words))]
        for k in range(2, min(self.ngrams, len(words)) + 1):
            runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
            found.append(np.fromiter(map(self.__getitem__, runs), np.int32, len(runs)))
        return len(words), np.concatenate(found)


def bucket_totals(texts: DataFrame, buckets: int = 10_000, ngrams: int = 1, text: str = "text") -> DataFrame:
    """``bucket, n``: how many features of all texts fall in each bucket that has any.

    Every task counts on its own and hands on one row per bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, ngrams), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(features.of(value.as_py())[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    counted = own_names(texts, text).mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000, ngrams: int = 1, text: str = "text") -> np.ndarray:
    """The whole-number gain of each bucket, 1000 times the log of the ratio of smoothed shares.

    The driver gets one number per bucket from either side.
    """
    sides = []
    for texts in (corpus, target):
        counts = np.zeros(buckets)
        for row in bucket_totals(texts, buckets, ngrams, text).collect():
            counts[row["bucket"]] = row["n"]
        sides.append(counts)
    s, t = sides
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], dtype=np.int64)


class GainPlanes:
    """Gains as bit planes by sign; sums of counts times gains by AND and popcount."""

    def __init__(self, gains: np.ndarray):
        self.buckets = len(gains)
        self.bits = int(np.abs(gains).max(initial=1)).bit_length()
        self.planes = []
        for sign in (1, -1):
            magnitude = np.maximum(sign * gains, 0)
            for k in range(self.bits):
                plane = self._pack(((magnitude >> k) & 1)[None, :])[0]
                if plane.any():
                    self.planes.append((sign << k, plane))

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        width = -(-self.buckets // 64) * 8
        packed = np.zeros((len(bits), width), np.uint8)
        filled = np.packbits(bits.astype(np.uint8), axis=1)
        packed[:, : filled.shape[1]] = filled
        return packed.view(np.uint64)

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """For each row of bucket counts, the sum of count times gain over the buckets."""
        total, left, power = np.zeros(len(counts), np.int64), counts.copy(), 1
        rows = np.arange(len(counts))
        while len(rows):
            plane = self._pack(left & 1)
            for value, gains in self.planes:
                ones = np.bitwise_count(plane & gains).sum(axis=1, dtype=np.int64)
                total[rows] += ones * (value * power)
            left >>= 1
            power *= 2
            more = left.any(axis=1)
            rows, left = rows[more], left[more]
        return total


def weigh(docs: DataFrame, gains: np.ndarray, ngrams: int = 1, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, n_features, weight``: the floored mean gain of a row's features, 0 without any.

    Input columns named like a result give way to it; null texts have no words.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    text_at = next(i for i, f in enumerate(docs.schema) if f.name == text)
    buckets = len(gains)

    def make():
        features, planes = Features(buckets, ngrams), GainPlanes(gains)

        def work(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            n_words, n_features, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.column(text_at).slice(start, BLOCK)
                counts = np.zeros((len(part), buckets), np.int32)
                for i, value in enumerate(part):
                    n_words[start + i], found = features.of(value.as_py())
                    n_features[start + i] = len(found)
                    counts[i] = np.bincount(found, minlength=buckets)
                sums[start : start + len(part)] = planes.sums(counts)
            return {"n_words": n_words, "n_features": n_features, "weight": sums // np.maximum(n_features, 1)}

        return work

    return arrow_map(docs, make, schema, keep=True)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    buckets: int = 10_000,
    ngrams: int = 1,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``; drawn rows have a rank.

    Of the N rows with at least ``least_words`` words those with the
    ``percent * N // 100`` highest scores are drawn (a sample without
    replacement by Gumbel noise from the SHA-256 of ``seed:doc_id``), ties to
    the smaller ``doc_id``, then to fewer features; null ids come last and
    count as an empty id in the noise.  Repeated rows are rows of their own.
    Null texts have no words, weight 0 and no rank; long texts are read whole.
    An empty corpus gives no rows, an empty target gains of the corpus alone.
    Other input columns, clashing names too, are left out.

    Ranks come from a range partitioning on the whole order, so equal scores
    are no hot spot.
    """
    gains = bucket_gains(docs, target, buckets, ngrams)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    weighed = weigh(own_names(docs, "doc_id", "text"), gains, ngrams).drop("text")
    scored = written(weighed.withColumn("score", F.col("weight") + noise), "scores")
    may = F.col("n_words") >= least_words
    most = percent * scored.where(may).count() // 100
    ordered = scored.where(may).select(
        "*", (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_unknown")
    )
    ranked = dense_row_id(ordered, ["_down", "_unknown", "doc_id", "n_features"], "rank").drop("_down", "_unknown")
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))
