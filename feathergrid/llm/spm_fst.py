"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The machine is a composition of three: the normaliser (a blank before the text,
blanks as U+2581), the pieces (a string becomes a piece's id, with its cost),
and byte fallback (a character that no piece has becomes its UTF-8 bytes' ids).
Composed with an input it is a lattice of states (place, last piece), and the
encoding is its shortest path in the tropical semiring.

For unigram models an arc costs minus the piece's score.  For BPE models the
costs are 0 or infinity: two pieces may follow each other only if merging their
characters gives just these two.  Merges inside a piece are independent of what
lies beyond its edges until one crosses an edge, and the first merge that would
cross an edge in the text would also cross it in the two pieces alone; so the
only path of finite cost is the BPE encoding.

No piece spans two characters that never stand side by side in a piece, so
texts are cut there and the parts, far fewer, are encoded once.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import own_names

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_UNIGRAM, _BPE = 1, 2
_NO_PIECE = -1


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, raw[i : i + size]
        i += size


class Model:
    """Pieces, types and settings of a model file."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part[1].decode())
                self.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                self.types.append(part.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, _UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("only the identity normaliser with a blank before the text is supported")
        if not self.byte_fallback or trainer.get(24, 0) or set(self.types) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only models with byte fallback, blanks as prefixes and no user-defined pieces are supported")


class Transducer:
    """Encoder and decoder; what it has learned of parts and pairs of pieces is kept, and dropped when it gets large."""

    def __init__(self, raw: bytes, kept: int = 400_000):
        self.model = model = Model(raw)
        self.kept = kept
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == _NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t == _BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.prefixes = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.together = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.follows: dict[int, bool] = {}  # by last piece * number of pieces + piece
        self.parts: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, bytes] = {}
        self.cost = [0.0 if model.kind == _BPE else -s for s in model.scores]
        low = min(self.cost, default=0.0)
        if low < 0:  # a constant per character keeps the order of paths and the costs non-negative
            self.cost = [c - low * len(p) for c, p in zip(self.cost, model.pieces)]
        self.unknown_cost = max(self.cost, default=0.0) + 10.0
        self.texts: list[str | None] = [p.replace(SPACE, " ") if t == _NORMAL else None for p, t in zip(model.pieces, model.types)]
        self.byte_of = {i: b for b, i in self.bytes.items()}

    # The pieces' machine.

    def merged(self, text: str) -> list[str]:
        """The characters of a short string after all merges: best score first, then the leftmost."""
        parts = list(text)
        scores = self.model.scores
        while len(parts) > 1:
            best, at = -float("inf"), -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and scores[piece] > best:
                    best, at = scores[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether piece ``b`` can stand after ``a`` (or, after no piece, be formed at all)."""
        right = self.model.pieces[b]
        if a == _NO_PIECE:
            fits = self.merged(right) == [right]
        else:
            left = self.model.pieces[a]
            fits = self.merged(right) == [right] and self.merged(left + right) == [left, right]
        if len(self.follows) >= 2 * self.kept:
            self.follows.clear()
        self.follows[a * len(self.model.pieces) + b] = fits
        return fits

    def arcs(self, text: str, place: int) -> list[tuple[int, int]]:
        """``(end, piece)`` of the pieces that begin at a place, the shortest first; a character without one has a byte arc."""
        ids, prefixes, out = self.ids, self.prefixes, []
        for end in range(place + 1, min(len(text), place + self.longest) + 1):
            part = text[place:end]
            if part not in prefixes:
                break
            if part in ids:
                out.append((end, ids[part]))
        if not out or out[0][0] > place + 1:
            out.insert(0, (place + 1, _NO_PIECE - 1 - ord(text[place])))  # numbered below _NO_PIECE
        return out

    def path(self, text: str) -> tuple[int, ...]:
        """Shortest path through the lattice of a normalised string."""
        way = self._any_path(text) if self.model.kind == _BPE else self._cheapest_path(text)
        out: list[int] = []
        while way is not None:
            piece, way = way
            if piece < _NO_PIECE:
                out.extend(self.bytes[b] for b in reversed(chr(_NO_PIECE - 1 - piece).encode("utf-8", "surrogatepass")))
            else:
                out.append(piece)
        out.reverse()
        return tuple(out)

    def _any_path(self, text: str) -> tuple | None:
        """All finite costs are 0: the frontier needs no order, and the longest pieces are tried first."""
        follows, size, many = self.follows, len(text), len(self.model.pieces)
        arcs: list[list[tuple[int, int]] | None] = [None] * size
        stack: list[tuple[int, int, tuple | None]] = [(0, _NO_PIECE, None)]
        done: set[tuple[int, int]] = set()
        while stack:
            place, last, way = stack.pop()
            if place == size:
                return way
            if (place, last) in done:
                continue
            done.add((place, last))
            here = arcs[place]
            if here is None:
                here = arcs[place] = self.arcs(text, place)
            for end, piece in here:
                if piece < 0:  # a character without a piece joins nothing: what follows it stands alone
                    stack.append((end, _NO_PIECE, (piece, way)))
                    continue
                fits = follows.get(last * many + piece)
                if fits is None:
                    fits = self.may_follow(last, piece)
                if fits:
                    stack.append((end, piece, (piece, way)))
        return None

    def _cheapest_path(self, text: str) -> tuple | None:
        """Dijkstra; costs do not depend on the piece before, so a place is a state."""
        heap: list[tuple] = [(0.0, 0, 0, None)]  # cost, place, serial, way here
        done: set[int] = set()
        serial = 0
        while heap:
            cost, place, _, way = heapq.heappop(heap)
            if place == len(text):
                return way
            if place in done:
                continue
            done.add(place)
            for end, piece in self.arcs(text, place):
                serial += 1
                step = self.cost[piece] if piece >= 0 else self.unknown_cost
                heapq.heappush(heap, (cost + step, end, serial, (piece, way)))
        return None

    def part(self, text: str) -> tuple[int, ...]:
        found = self.parts.get(text)
        if found is None:
            if len(self.parts) >= self.kept:
                self.parts.clear()
            found = self.parts[text] = self.path(text)
        return found

    def _cut(self, text: str) -> Iterator[str]:
        start = 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in self.together:
                yield text[start:i]
                start = i
        if text:
            yield text[start:]

    def chunk(self, text: str) -> bytes:
        """Ids of a normalised string as little-endian 32-bit bytes."""
        found = self.chunks.get(text)
        if found is None:
            if len(self.chunks) >= self.kept:
                self.chunks.clear()
            ids = [i for part in self._cut(text) for i in self.part(part)]
            found = self.chunks[text] = np.array(ids, dtype="<i4").tobytes()
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return np.zeros(0, dtype="<i4")
        normal = (SPACE + text).replace(" ", SPACE)
        words = normal.split(SPACE)
        # No piece has a blank after another character, so each word begins a string of its own with the blanks before it.
        chunk, known = self.chunk, self.chunks
        out, blanks = [words[0].encode() and chunk(words[0])] if words[0] else [], 0
        for word in words[1:]:
            blanks += 1
            if word:
                key = SPACE * blanks + word
                out.append(known[key] if key in known else chunk(key))
                blanks = 0
        if blanks:
            out.append(chunk(SPACE * blanks))
        return np.frombuffer(b"".join(out), dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces in a row, byte pieces as UTF-8, without the blank that encoding put before the text."""
        texts = self.texts
        parts = [texts[i] for i in ids.tolist()]
        if None in parts:
            pending, whole = bytearray(), []
            for i, text in zip(ids.tolist(), parts):
                if i in self.byte_of:
                    pending.append(self.byte_of[i])
                    continue
                if pending:
                    whole.append(pending.decode("utf-8", "replace"))
                    pending = bytearray()
                whole.append(text if text is not None else (" ⁇ " if self.model.types[i] == _UNKNOWN else ""))
            whole.append(pending.decode("utf-8", "replace"))
            parts = whole
        out = "".join(parts)
        return out[1:] if out.startswith(" ") else out


def _check(model: Model) -> None:
    if any(SPACE in p.lstrip(SPACE) for p, t in zip(model.pieces, model.types) if t == _NORMAL):
        raise ValueError("a piece holds a blank after another character")


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """The transducer of a model file; it lives as long as the Python worker."""
    if path not in _MACHINES:
        with open(path, "rb") as file:
            made = Transducer(file.read())
        _check(made.model)
        _MACHINES[path] = made
    return _MACHINES[path]


def encode(documents: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, n_ids, decoded_hash`` of every whole text.

    ``decoded_hash`` is the XXH64 (seed 0, as a signed long) of the UTF-8 text
    decoded from the ids again.  Null and empty texts have no ids.  Repeated rows give equal rows;
    an empty table gives none.  ``model`` is a path every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = machine(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [made.encode(t.as_py()) for t in part.column(1)]
                counts = np.array([len(f) for f in found], dtype=np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else [], pa.int32()))
                back = [xxhash.xxh64_intdigest(made.decode(f).encode("utf-8", "surrogatepass")) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), ids, pa.array(counts), pa.array(np.array(back, dtype=np.uint64).view(np.int64))],
                    names=["doc_id", "ids", "n_ids", "decoded_hash"],
                )

    return own_names(documents, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_ids long, decoded_hash long")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = machine(model)
        for batch in batches:
            texts = [None if x.as_py() is None else made.decode(np.asarray(x.values)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return own_names(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
