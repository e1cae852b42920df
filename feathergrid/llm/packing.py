"""Packing of tokenised documents into fixed windows by multiway differencing (Karmarkar-Karp).

A document's ids are cut into whole windows and a remainder; the remainder is
cut into equal parts of at most ``part`` ids.  The parts are dealt by hash to
groups of about ``WINDOWS_PER_GROUP`` windows.  Within a group, partial
partitions are merged two at a time, the most uneven first, the fullest windows
of one meeting the emptiest of the other, which leaves near-equal windows; the
number of windows rises by one for as long as any exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names, written

CAPACITY = 2048
PART = 512
WINDOWS_PER_GROUP = 128
END_ID = 1

#: Fixed value: the tokenizer's own split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Pretokens(dict):
    """Lowercase pre-token -> its ids as little-endian 32-bit bytes.

    The tokenizer here neither normalises nor splits: a pre-token needs neither.
    """

    def __init__(self, path: str, size: int):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        super().__init__()
        self.size = size
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, token: str) -> bytes:
        if len(self) >= self.size:
            self.clear()
        value = encode_whole(self.tokenizer, token)
        self[token] = value
        return value


class _Chunks(dict):
    """A piece of text between blanks or line ends -> its ids as bytes.

    The tokenizer drops white space and no token crosses it, so the ids of a
    text are those of its chunks in a row.  Chunks of plain letters, digits and
    signs are split further into pre-tokens, which are far fewer; other chunks
    go to the tokenizer whole, so its normaliser decides.  Both tables start
    anew when full.
    """

    def __init__(self, path: str, size: int, pretokens: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.size = size
        self.tokenizer = Tokenizer.from_file(path)
        self.pretokens = _Pretokens(path, pretokens)
        self.find = regex.compile(SPLIT).findall
        self[""] = b""

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.size:
            self.clear()
            self[""] = b""
        if chunk.isascii() and chunk.isalpha():
            value = self.pretokens[chunk.lower()]
        elif _plain(chunk):
            value = b"".join(map(self.pretokens.__getitem__, self.find(chunk.lower())))
        else:
            value = encode_whole(self.tokenizer, chunk)
        self[chunk] = value
        return value


#: Letters whose composed form and lowercase are one character each: Latin-1 and Latin Extended-A without dotted I.
_PLAIN = regex.compile(r"[\x21-\x7e¡-¬®-įĲ-ž]*")


def _plain(chunk: str) -> bool:
    return _PLAIN.fullmatch(chunk) is not None and "<|" not in chunk


def encode_whole(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


#: Most chunks and pre-tokens that a Python worker remembers.
KNOWN = (600_000, 900_000)
_CHUNKS: dict[str, _Chunks] = {}


def chunk_ids(path: str, known: tuple[int, int] = KNOWN) -> _Chunks:
    """The chunk table of the tokenizer file; it lives as long as the Python worker, or until another size is asked for."""
    found = _CHUNKS.get(path)
    if found is None or (found.size, found.pretokens.size) != tuple(known):
        _CHUNKS.pop(path, None)
        found = _CHUNKS[path] = _Chunks(path, *known)
    return found


def cut(n: int, capacity: int = CAPACITY, part: int = PART) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids."""
    whole = n - n % capacity
    for start in range(0, whole, capacity):
        yield start, capacity
    rest = n - whole
    if rest:
        parts = -(-rest // part)
        for k in range(parts):
            a, b = rest * k // parts, rest * (k + 1) // parts
            yield whole + a, b - a


def tokenised(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, part: int = PART, with_ids: bool = False, known: tuple[int, int] = KNOWN) -> DataFrame:
    """The pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens`` and, if wanted, ``ids``.

    ``ids`` is the piece's ids as little-endian 32-bit bytes.  Every document
    ends with ``END_ID``; a null text is just that.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_ids(tokenizer, known)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").replace("\n", " ").split(" ")
                ids = b"".join(map(chunks.__getitem__, words)) + end
                n = len(ids) // 4
                for start, length in cut(n, capacity, part):
                    piece = ids[4 * start : 4 * (start + length)]
                    out.append((doc_id, start, length, zlib.crc32(piece), n, *([piece] if with_ids else [])))
            types = [pa.int64()] * 5 + [pa.binary()] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(types)]
            columns = zip(*out) if out else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)

    return own_names(documents, "doc_id", "text").mapInArrow(run, schema)


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Split the lengths' indexes into that many windows with near-equal sums, by largest differencing.

    A partial partition is an ascending list of ``(sum, members)`` of its
    non-empty windows; members form a tree of pairs that is flattened at the end.
    """
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    serial = len(lengths)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        over = len(a) + len(b) - windows
        if over <= 0:
            merged = a + b
        else:  # the `over` smallest windows of one meet the `over` smallest of the other, large with small
            merged = a[over:] + b[over:]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[:over], reversed(b[:over]))]
        merged.sort(key=_sum)
        spread = merged[-1][0] - (merged[0][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    out = []
    for _, members in heap[0][2] if heap else []:
        stack, flat = [members], []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            else:
                flat.append(node)
        out.append(flat)
    return out


def _sum(window: tuple) -> int:
    return window[0]


def fill(lengths: list[int], capacity: int) -> list[list[int]]:
    """As few near-equal windows as differencing fits into the capacity."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        found = difference(lengths, windows)
        if all(sum(lengths[i] for i in w) <= capacity for w in found):
            return found
        windows += 1


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, part: int = PART, with_ids: bool = False, known: tuple[int, int] = KNOWN) -> DataFrame:
    """Pieces with their place: the columns of ``tokenised`` plus ``sequence_id`` and ``offset``.

    Null or empty texts hold only the end id.  Documents are never told apart by
    ``doc_id``, so null and repeated ids are packed like any other row.  An
    empty table gives no pieces.  ``known`` bounds what a worker remembers of the
    tokenizer's work, and changes no result.
    """
    if part > capacity:
        raise ValueError("a part must fit into a window")
    pieces = written(tokenised(documents, tokenizer, capacity, part, with_ids, known), "pieces")
    pieces = pieces.withColumn("piece", F.monotonically_increasing_id())
    parts = pieces.where(F.col("length") < capacity)
    total = parts.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (capacity * WINDOWS_PER_GROUP)))
    names = [c for c in pieces.columns if c != "piece"]
    first = len(names)

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        lengths = group.column("length").to_pylist()
        number = group.column("bin")[0].as_py() if group.num_rows else 0
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for k, window in enumerate(fill(lengths, capacity)):
            at = 0
            for i in sorted(window):
                sequence[i], offset[i] = (number << 32) + k, at
                at += lengths[i]
        table = group.select(names)
        return table.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields[:first]) + ", sequence_id long, offset long"
    placed = parts.withColumn("bin", F.pmod(F.xxhash64("piece"), F.lit(groups))).groupBy("bin").applyInArrow(place, schema)
    whole = pieces.where(F.col("length") == capacity).select(
        *names, (F.lit(1 << 62) + F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(whole)
