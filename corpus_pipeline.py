"""A training corpus from raw documents, in five stages of the operators in feathergrid.llm.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept.  ``run`` writes each stage's result as Parquet below the
shared folder and reads it again, so a lost executor never costs more than a
stage, and the rows of a stage's input have a fixed place.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feathergrid.llm import exact_dedup, lang_id, near_dedup, packing, pii
from feathergrid.llm.common import written
from feathergrid.session import table


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: no text, or no letter in it."""
    return lang_id.keep_recognised(docs, lang_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words, 0.8) the one with the smallest id stays."""
    return near_dedup.drop_near_copies(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text gives way to the data's kind, and terms that reveal it to theirs."""
    return pii.sanitise(docs, everywhere=True)


#: Chunks and pre-tokens a worker remembers; they stay in its memory while other stages run.
KNOWN = (200_000, 400_000)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence, place in it and token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, known=KNOWN)


STAGES = [
    ("language", recognise_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", remove_personal_data),
    ("packing", pack_sequences),
]

#: The trained language model, the near-duplicate classes and the tokenizer are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
