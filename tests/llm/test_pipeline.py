"""The stages one after the other on planted cases, and the whole pipeline against the operators' brute force."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_of_planted_cases(spark, tmp_path):
    body = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    near = body.replace("wab", "other")
    rows = [
        (1, body, "en"),
        (2, body.replace(" ", "\n"), "en"),  # copy
        (3, near, "en"),  # near copy
        (4, None, "en"),
        (5, "12 34", "en"),
        (6, "Mail me at jo@corp.example today", "en"),
        (7, "clean words only", "fr"),
        (7, "clean words only", "fr"),
        (None, "no id here", "de"),
    ]
    frame = pd.DataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    frame.to_parquet(tmp_path / "documents.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    from feathergrid.llm.common import written

    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == list(frame.columns)
        left.append(sorted(str(r.doc_id) for r in docs.collect()))
    assert left[0] == ["1", "2", "3", "6", "7", "7", "None"]
    assert left[1] == ["1", "3", "6", "7", "None"]
    assert left[2] == left[3] == ["1", "6", "7", "None"]
    cleaned = {r.doc_id: r.text for r in docs.collect()}
    assert cleaned[6] == "Mail me at [email] today" and cleaned[1] == body
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, 6, 7, None}


def test_language_stage_without_labels_keeps_clean_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "clean words", None), (2, "12 34", None), (3, None, None), (None, "no id", "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.recognise_language(spark, docs, str(tmp_path))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_pipeline_result_holds_the_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(1, "clean words only"), (2, None)], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()}
    want = [*tokenizer.encode("clean words only", add_special_tokens=False).ids, 1]
    assert np.frombuffer(got[1], "<u4").tolist() == want and np.frombuffer(got[2], "<u4").tolist() == [1]


def test_pipeline_run_covers_all_documents(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    docs = docs[docs["text"].map(lambda t: any(c.isalpha() for c in t))]
    docs["key"] = docs["text"].map(lambda t: re.sub("[ \t-\r]+", " ", t))
    distinct = docs.sort_values("doc_id").drop_duplicates("key")
    sets = {i: _shingles(t) for i, t in zip(distinct["doc_id"], distinct["text"])}
    kept, parent = [], {}
    for i in sorted(sets):
        near = {parent[j] for j in parent if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
        parent[i] = min(near, default=i)
        for j in parent:
            if parent[j] in near:
                parent[j] = parent[i]
    kept = {i for i in parent if parent[i] == i}
    assert set(got["doc_id"]) == kept
    first = got[got["start"] == 0]
    assert len(first) == len(kept) and (got.groupby("doc_id")["length"].sum() == got.groupby("doc_id")["doc_tokens"].first()).all()


def _shingles(text):
    words = text.encode().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()
