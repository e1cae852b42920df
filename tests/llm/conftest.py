from __future__ import annotations

import pytest

EXTRA = "row long, node string, digest string, score double, fold int, KEY string"


def _words(a, b, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(a, b))


EDGE = [
    (1, _words(0, 60), "en"),
    (2, _words(0, 60), "en"),  # copy
    (3, "  " + _words(0, 60).replace(" ", "\t\n"), "en"),  # copy but for white space, with a blank before
    (4, None, "en"),
    (5, "", None),
    (6, " \n\t ", "fr"),
    (7, "one two", "fr"),
    (7, "one two", "fr"),  # repeated row
    (None, _words(0, 60), "de"),  # null id
    (None, None, None),
    (8, "x" * 300_000, "de"),  # one very long word
    (9, "la " * 50_000, "es"),  # very long, one word
    (10, _words(0, 3) + " " + _words(5, 70), "en"),
    (11, "1234 5678 !!", "en"),  # no letter
    (12, "straße naïve 日本語 😀   \x1c \xa0 end", "de"),
    (13, "<|endoftext|> it's\r\nOK", "en"),
    (-5, "early", "en"),
]


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty and long texts, copies, repeated rows and columns whose names the operators use."""
    rows = [(i, t, g, "s", len(t or ""), 1, "n", "d", 0.5, 3, "k") for i, t, g in EDGE]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    return spark.createDataFrame(rows, schema).coalesce(2)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
