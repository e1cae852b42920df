"""Near-duplicates of word shingles by DartMinHash, banded joining and exact verification.

A document is a weighted set of shingles.  Think of each element's weight as a
stretch on which darts land at random; every dart has a rank that grows with
unit rate, and falls on one of ``COORDINATES`` coordinates.  The signature keeps
the earliest dart of each coordinate.  Darts come from hashes of element, unit
of weight and serial number, so documents that share an element share its darts,
and two coordinates agree with the probability of weighted Jaccard similarity.
Only darts of the first ranks are thrown, about k log k per document, and more
while a coordinate is still empty.

Equal shingle sets become one node.  Nodes meet in bands of the signature.  A
band's centre is compared with the band's other nodes, exactly, and linked nodes
merge.  Bands that still hold several components are cut into chunks of bounded
size; a task holds one chunk of the nodes outside the band's largest component
and one chunk of all its nodes, and writes links only, never pairs.  So in the
end every pair in a band was compared or is already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHash, fresh_name, mix, uniform, words_of, written
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 128
ROWS_PER_BAND = 4
#: A table of nodes up to this many rows (a long each) is sent to all executors, a larger one is shuffled.
SMALL_NODES = 200_000
#: Words whose hashes a task remembers.
KNOWN_WORDS = 100_000
#: Documents whose sets are handed on together.
SLICE_ROWS = 512
#: Elements of one chunk of a band on either side of a comparison (8 bytes each).
CHUNK_ELEMENTS = 1 << 18

_ODD = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: WordHash, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs.  A shorter text is one shingle of all its words."""
    hashes = words.of(words_of(text))
    if not len(hashes):
        return hashes, np.zeros(0, dtype=np.int64)
    width = min(size, len(hashes))
    hashes = mix(hashes)
    total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for j in range(width):
        total += hashes[j : len(hashes) - width + 1 + j] * _ODD[j % SHINGLE] + np.uint64(j)
    return np.unique(mix(total + np.uint64(width)), return_counts=True)


def darts(elements: np.ndarray, weights: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """``(rank, name)`` of all darts with rank up to ``limit`` that hit the weighted elements.

    Each unit of weight of an element is a cell.  Its darts are numbered, and a
    dart's hash gives its name and, by the upper bits, its distance in rank to
    the dart before.
    """
    units = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    cell = mix(elements[owner] + (unit.astype(np.uint64) + np.uint64(1)) * _GOLD)
    part = weights[owner] - unit  # below 1 where only a part of the cell belongs to the element
    whole = not (part < 1).any()
    ranks, names = [], []
    reached, serial, columns = np.zeros(len(cell)), 1, 1
    while len(cell):
        numbers = np.arange(serial, serial + columns, dtype=np.uint64) * _GOLD
        name = mix(cell[:, None] + numbers[None, :])
        rank = reached[:, None] + np.cumsum(-np.log(uniform(name)), axis=1)
        hit = rank <= limit
        on = hit if whole else hit & (uniform(mix(name + np.uint64(7))) <= part[:, None])
        ranks.append(rank[on])
        names.append(name[on])
        more = np.flatnonzero(hit[:, -1])
        cell, part, reached = cell[more], part[more], rank[more, -1]
        serial += columns
        columns = int(max(0.0, limit - reached.min() if len(more) else 0.0) + 2.0 * np.sqrt(limit) + 2.0)
    return np.concatenate(ranks), np.concatenate(names)


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """For each coordinate, told by the lowest bits of the names, the name of its earliest dart."""
    limit = k * (np.log(k) + 2.0) / float(weights.sum())
    while True:
        rank, name = darts(elements, weights, limit)
        name = name[np.argsort(rank, kind="stable")]
        where, first = np.unique((name & np.uint64(2047)) * np.uint64(k) >> np.uint64(11), return_index=True)
        if len(where) == k:
            return name[first]
        limit *= 1.5


def bands(sig: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """One hash per band of the signature."""
    table = sig.reshape(-1, rows)
    total = mix(np.arange(len(table), dtype=np.uint64) + np.uint64(1))
    for j in range(rows):
        total = mix(total * _GOLD + table[:, j])
    return total.astype(np.int64)


def _weights(counts: np.ndarray, weighted: bool) -> np.ndarray:
    return counts.astype(np.float64) if weighted else np.ones(len(counts))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what a task holds of its results is theirs."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _sketch(documents: DataFrame, row: str, weighted: bool) -> DataFrame:
    """``row, doc_id, digest, n, bands`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash(KNOWN_WORDS)
        for batch in _slices(batches):
            digest, size, found = [], [], []
            for text in batch.column(2):
                element, count = shingles(text.as_py(), words)
                weight = _weights(count, weighted)
                size.append(float(weight.sum()))
                name = element.tobytes() + (count.astype(np.int64).tobytes() if weighted else b"")
                digest.append(xxhash.xxh3_128_digest(name) if len(element) else None)
                found.append(bands(signature(element, weight)) if len(element) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(size, pa.float64()), pa.array(found, pa.list_(pa.int64()))],
                names=[row, "doc_id", "digest", "n", "bands"],
            )

    schema = f"{row} long, doc_id long, digest binary, n double, bands array<long>"
    return documents.select(row, "doc_id", "text").mapInArrow(run, schema)


def _sets(documents: DataFrame, row: str, weighted: bool) -> DataFrame:
    """``node, digest, elements`` of the given documents; a weighted element stands once per unit of weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash(KNOWN_WORDS)
        for batch in _slices(batches):
            digest, found = [], []
            for text in batch.column(1):
                element, count = shingles(text.as_py(), words)
                digest.append(xxhash.xxh3_128_digest(element.tobytes() + (count.astype(np.int64).tobytes() if weighted else b"")))
                if weighted:
                    unit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    element = mix(np.repeat(element, count) + unit.astype(np.uint64) * _GOLD)
                found.append(element.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digest, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["node", "digest", "elements"]
            )

    return documents.select(row, "text").mapInArrow(run, "node long, digest binary, elements array<long>")


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """``row, doc_id, class_id, class_size, kept`` of every document (columns ``doc_id``, ``text``).

    Documents whose shingles of ``SHINGLE`` words have a Jaccard similarity of
    at least ``similarity`` are linked, and linked documents form a class; with
    ``weighted`` a shingle weighs as often as it occurs.  ``class_id`` is the
    smallest ``doc_id`` of the class, and exactly one row with it is ``kept``
    (the first by ``row``, the place in the table; null ids come last).  Null
    texts and texts without words are like no other: each is a class of its own.
    A text of fewer than five words is one shingle; long texts are read whole, and
    a task holds the sets of about ``CHUNK_ELEMENTS`` shingles a side.  Repeated
    rows are rows of one class, an empty table gives no rows, further columns play
    no part whatever their names.  ``documents`` must be a
    table that reads the same each time; if it is not, the job stops.
    """
    row = fresh_name(documents, "row")
    placed = documents.select(F.monotonically_increasing_id().alias(row), "doc_id", "text")
    sketch = written(_sketch(placed, row, weighted), "sketches")

    # One node per distinct shingle set, named by its first row.
    nodes = written(
        sketch.where("digest IS NOT NULL").groupBy("digest").agg(F.min(row).alias("node"), F.max("n").alias("n")), "nodes"
    )
    of_node = sketch.where("digest IS NOT NULL").select(F.col(row).alias("node"), "bands").join(nodes, "node").select(
        "node", "n", F.explode("bands").alias("band")
    )
    banded = written(of_node, "bands")
    crowded = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1").select("band")
    live = written(banded.join(written(crowded, "crowded-bands"), "band"), "live-bands")

    meeting = written(live.select("node").distinct(), "meeting")
    few = meeting.count() <= SMALL_NODES
    wanted = meeting.withColumnRenamed("node", row)
    again = placed.join(F.broadcast(wanted) if few else wanted, row, "left_semi")
    sets = written(_sets(again, row, weighted), "sets")
    _same_rows(sets, nodes)

    # First round: every node with its band's centre.
    centre = written(live.groupBy("band").agg(F.min_by(F.struct("node", "n"), F.struct(F.xxhash64("node"), "node")).alias("c")), "first-centres")
    met = live.join(centre, "band").where(F.col("node") != F.col("c.node")).where(_alike("n", "c.n", similarity))
    links = written(_verified(_ordered(met, "node", "c.node"), sets, similarity), "verified")
    roots = components(links)
    live = live.join(centre.select("band", F.col("c.node").alias("node")), ["band", "node"], "left_anti")
    live = written(_open(live, roots), "open-bands")

    # What the centres left open.
    links = links.union(written(_block_links(live, sets, similarity), "block-links"))
    roots = components(links)

    rooted = written(nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("class")), "classes")
    classed = sketch.select(row, "doc_id", "digest").join(rooted, "digest", "left").select(
        row, "doc_id", F.coalesce("class", F.col(row)).alias("class")
    )
    classed = written(classed, "classed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first")
    heads = written(classed.groupBy("class").agg(first, F.count("*").alias("class_size")), "heads")
    return classed.join(heads, "class").select(
        F.col(row).alias("row"),
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        (F.col(row) == F.col(f"first.{row}")).alias("kept"),
    )


def _alike(n: str, m: str, similarity: float) -> Column:
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _open(live: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the bands whose nodes are not all in one component, with their component."""
    member = live.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    still = member.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    return member.join(written(still, "bands-of-several"), "band")


def _block_links(live: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links that connect what can be connected inside each band of ``live`` (``band, node, n, root``).

    A pair of different components has a node outside the largest, so only
    chunks of such nodes meet the chunks of all.  Small bands share a task.
    """
    weights = live.groupBy("band", "root").agg(F.sum("n").alias("n"))
    total, most = F.sum("n").alias("total"), F.max("n").alias("most")
    bands_ = weights.groupBy("band").agg(total, most, F.max_by("root", F.struct("n", "root")).alias("major"))

    def chunks(elements: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(elements / CHUNK_ELEMENTS)).cast("int")

    shape = written(bands_.select("band", "major", chunks(F.col("total")).alias("wide"), chunks(F.col("total") - F.col("most")).alias("high"), "total"), "band-shapes")
    bins = int(shape.agg(F.sum("total")).first()[0] or 0) // CHUNK_ELEMENTS + 1
    bins = max(bins, int(live.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Bands of one chunk share a task; a larger band has tasks of its own.
    lane = F.when((F.col("wide") == 1) & (F.col("high") == 1), F.pmod(F.xxhash64("band"), F.lit(bins))).otherwise(F.xxhash64("band"))
    places = live.groupBy("node").agg(F.array_sort(F.collect_list("band")).alias("common"))  # at most all bands of a signature
    known = sets.select("node", "elements").join(places, "node")
    member = live.select("band", "node", "root").join(shape, "band").join(known, "node")

    def side(rows: DataFrame, own: str, other: str, mine: str, yours: str) -> DataFrame:
        """Rows with the cell they take part in: their own chunk, and each of the other side's."""
        return rows.select(
            lane.alias("lane"),
            F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(yours),
            "band", "node", "root", (F.col("root") == F.col("major")).alias("inside"), "common", "elements",
        )

    few, all_ = side(member.where("root <> major"), "high", "wide", "i", "j"), side(member, "wide", "high", "j", "i")
    few = few.toDF(*[f"x_{c}" for c in few.columns])  # both sides come from the same rows

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        x = x.rename_columns([c.removeprefix("x_") for c in x.column_names])
        found = _Cell(x, y, similarity).links() if x.num_rows and y.num_rows else []
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    cell = ["lane", "i", "j"]
    return few.groupBy(*[f"x_{c}" for c in cell]).cogroup(all_.groupBy(*cell)).applyInArrow(compare, "a long, b long")


class _Cell:
    """The nodes of one task: ``x`` are compared with ``y``, band by band."""

    def __init__(self, x: pa.Table, y: pa.Table, similarity: float):
        self.similarity = similarity
        (self.x_band, self.x_node, self.x_root, _), (self.y_band, self.y_node, self.y_root, self.y_inside) = (
            [t[c].to_numpy() for c in ("band", "node", "root", "inside")] for t in (x, y)
        )
        (self.x_common, self.x_at), (self.y_common, self.y_at) = (self._lists(t["common"]) for t in (x, y))
        (x_flat, self.x_from), (y_flat, self.y_from) = (self._lists(t["elements"]) for t in (x, y))
        # elements as small numbers, so that "has it" is a look-up
        known = np.unique(np.concatenate([x_flat, y_flat]))
        self.x_flat, self.y_flat = (np.searchsorted(known, flat).astype(np.int32) for flat in (x_flat, y_flat))
        self.has = np.zeros(len(known), dtype=bool)

    @staticmethod
    def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        lists = column.combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        return lists.flatten().to_numpy(), offsets

    def links(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        x_order, y_order = np.argsort(self.x_band, kind="stable"), np.argsort(self.y_band, kind="stable")
        for band in np.unique(self.x_band):
            x, y = (
                order[np.searchsorted(of[order], band, "left") : np.searchsorted(of[order], band, "right")]
                for order, of in ((x_order, self.x_band), (y_order, self.y_band))
            )
            out += self._band(band, x, y)
        return out

    def _band(self, band: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Links between ``x`` and ``y`` that join components; pairs of an earlier common band are left to it."""
        out: list[tuple[int, int]] = []
        sizes = np.diff(self.y_from)[y]
        flat = np.concatenate([self.y_flat[self.y_from[k] : self.y_from[k + 1]] for k in y])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        earlier: dict[int, list[int]] = {}
        for at, k in enumerate(y):
            for other in self.y_common[self.y_at[k] : self.y_at[k + 1]]:
                if other >= band:
                    break
                earlier.setdefault(int(other), []).append(at)
        label = self.y_root[y].copy()
        became: dict[int, int] = {}

        def component(r: int) -> int:
            while r in became:
                became[r] = r = became.get(became[r], became[r])
            return r

        node, inside, s = self.y_node[y], self.y_inside[y], self.similarity
        for k in x:
            mine, root = self.x_flat[self.x_from[k] : self.x_from[k + 1]], component(int(self.x_root[k]))
            size = len(mine)
            may = (label != root) & (inside | (node > self.x_node[k]))
            may &= np.minimum(sizes, size) >= s * np.maximum(sizes, size) - 1e-9
            for other in self.x_common[self.x_at[k] : self.x_at[k + 1]]:
                if other >= band:
                    break
                if int(other) in earlier:
                    may[earlier[int(other)]] = False
            if not may.any():
                continue
            self.has[mine] = True
            common = np.add.reduceat(self.has[flat], starts, dtype=np.int64)
            self.has[mine] = False
            for at in np.flatnonzero(may & (common >= s * (sizes + size - common) - 1e-9)):
                if label[at] != root:
                    out.append((int(min(self.x_node[k], node[at])), int(max(self.x_node[k], node[at]))))
                    gone = int(label[at])
                    label[label == gone] = became[gone] = root
        return out


def _same_rows(sets: DataFrame, nodes: DataFrame) -> None:
    """Stop if the second reading of the documents gave other rows than the first."""
    known = nodes.select("node", F.col("digest").alias("was"))
    moved = sets.select("node", "digest").join(known, "node").where("digest <> was").limit(1).count()
    if moved:
        raise ValueError("the documents read differently the second time; write them to a table first")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes whose sets reach the similarity, computed on the whole sets."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")


def drop_near_copies(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each near-duplicate class, with all its columns."""
    dropped = near_duplicates(documents, similarity).where("NOT kept").select("row")
    row = fresh_name(documents, "row")
    placed = documents.withColumn(row, F.monotonically_increasing_id())
    return placed.join(dropped.withColumnRenamed("row", row), row, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
