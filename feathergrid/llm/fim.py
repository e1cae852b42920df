"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and the parts are put in another order.

The units of a text (code points, or whatever ``unit`` says) come from one
full match of ``(unit)*``: the regex library keeps every repetition of a group,
so ``match.ends(1)`` holds the end of each unit.  Its length is the number of
units, and two look-ups in it are the offsets of both cuts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")

SCHEMA = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def _check_markers(markers: tuple[str, str, str]) -> None:
    """A marker must not run into text or another marker: then each is found where it was put, and only there."""
    if len(set(markers)) < 3:
        raise ValueError("the markers must differ")
    for a in markers:
        for b in markers:
            if not a or (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"markers {a!r} and {b!r} overlap")


def transform(
    docs: DataFrame,
    unit: str = ".",
    seed: int = 1,
    moved: int = 90,
    suffix_first: int = 20,
    markers: tuple[str, str, str] = MARKERS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output`` for every row.

    ``n`` counts the units; both cuts lie between units and are drawn from the
    SHA-256 of ``seed:key``, so a row always gets the same cuts.  ``form`` is
    ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle; of
    ``suffix_first`` rows in 100 moved ones) or ``plain``, the text as it is:
    for 100 - ``moved`` rows in 100, empty texts, and texts that hold a marker,
    so that every output can be turned back (``restored``).  ``prefix_chars``
    and ``middle_chars`` are code points, null if plain.

    A null text counts as empty, a null key as an empty one.  Repeated rows get
    the same result each; an empty table gives an empty one.  Texts are cut
    whole; the match takes about 120 bytes of memory a unit of the one text at
    hand.  A text that ``unit`` does not cover stays plain with ``n`` null.
    Input columns go along; those named like a result give way to it, other
    columns whose names clash are no matter.
    """
    _check_markers(markers)
    units = regex.compile(f"({unit})*", regex.DOTALL)
    p, s, m = markers
    key_at = next(i for i, f in enumerate(docs.schema) if f.name == key)
    text_at = next(i for i, f in enumerate(docs.schema) if f.name == text)

    def one(name: object, whole: str) -> tuple:
        match = units.fullmatch(whole)
        if match is None:
            return None, "plain", None, None, whole
        ends = match.ends(1)
        n = len(ends)
        digest = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        if not whole or h3 % 100 >= moved or p in whole or s in whole or m in whole:
            return n, "plain", None, None, whole
        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (first, last))
        if h4 % 100 < suffix_first:
            return n, "spm", a, b - a, f"{s}{whole[b:]}{p}{whole[:a]}{m}{whole[a:b]}"
        return n, "psm", a, b - a, f"{p}{whole[:a]}{s}{whole[b:]}{m}{whole[a:b]}"

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        rows = [one(k.as_py(), t.as_py() or "") for k, t in zip(batch.column(key_at), batch.column(text_at))]
        return {f.name: [row[i] for row in rows] for i, f in enumerate(SCHEMA)}

    return arrow_map(docs, lambda: work, SCHEMA, keep=True)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text behind an ``output`` of that ``form``; null if either is null."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in markers), -1)
    first, second, middle = (parts.getItem(i) for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, middle, second))
        .when(form == "spm", F.concat(second, middle, first))
        .when(form == "plain", output)
    )
