"""One query per operator, over its whole table, with the operator's production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import ann, chat, exact_dedup, fim, html_text, importance, lang_id, near_dedup, packing, pii, spm_fst, substring_dedup, toxicity
from .common import crc32_mod
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query(
    "op10_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g')) AS text_sha256 FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark)
    decided = index.add(table(spark, sf_dir, "documents"))
    index.close()
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("fold", crc32_mod("doc_id", 3))
    model = lang_id.fit(documents.where("fold <> 1"))
    rows = documents.select("doc_id", (F.coalesce(F.col("fold") == 1, F.lit(False))).alias("held_out"), "text")
    return lang_id.predict(rows, model).drop("text")


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc32_mod("doc_id", 5)
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents.where(fold != 0), table(spark, sf_dir, "labels").where(fold != 0))
    rows = documents.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(rows, model).drop("text")


@query("op6_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), everywhere=True)


@query("op3_nearest_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_fst.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op11_fill_in_middle",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    h AS (
      SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
             ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d
    ),
    c AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
    ),
    p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
    FROM p
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    digests = [
        F.sha2(text.cast("binary"), 256).alias(name)
        for name, text in (("output_sha256", F.col("output")), ("restored_sha256", fim.restored(F.col("output"), F.col("form"))))
    ]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query(
    "op12_importance_resampling",
    r"""
    WITH bits AS (
      SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
      FROM range(256) r(i)
    ),
    crc AS (SELECT list(c ORDER BY i) AS tab FROM bits),
    texts AS (
      SELECT 0 AS side, row_number() OVER () AS r, text FROM documents
      UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark
    ),
    words AS (
      SELECT side, r, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
    ),
    uses AS (SELECT side, r, word, count(*) AS n FROM words GROUP BY ALL),
    known AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM uses),
    hashed AS (
      SELECT word, xor(4294967295, list_reduce(
        [4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 10000 AS bucket FROM known, crc
    ),
    counts AS (SELECT side, r, bucket, sum(n)::DOUBLE AS n FROM uses JOIN hashed USING (word) GROUP BY ALL),
    sides AS (
      SELECT b AS bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
      FROM range(10000) q(b) LEFT JOIN counts ON bucket = b GROUP BY b
    ),
    gains AS (
      SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS gain
      FROM sides
    ),
    sums AS (
      SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
      FROM counts JOIN gains USING (bucket) WHERE side = 0 GROUP BY r
    ),
    scored AS (
      SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT
               + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM (SELECT doc_id, row_number() OVER () AS r FROM documents) LEFT JOIN sums USING (r)
    ),
    ranked AS (
      SELECT *, n_features >= 20 AS may, row_number() OVER (PARTITION BY n_features >= 20
        ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k FROM scored
    )
    SELECT doc_id, n_features, weight, score,
           CASE WHEN may AND k <= 10 * (SELECT count(*) FROM ranked WHERE may) // 100 THEN k END AS rank
    FROM ranked
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


@query(
    "op13_chat_format",
    r"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
    ),
    e AS (
      SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '###\ '), '</turn>', '</turn\>') AS body,
        '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE
        '?' || replace(replace(replace(replace(role, '\', '\\'), '### ', '###\ '), '</turn>', '</turn\>'), ': ', ':\ ') END
        || ': ' AS head FROM c
    ),
    l AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said FROM e)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, head, body)) AS turns_sha256,
           sum(length(said))::BIGINT AS loss_chars,
           sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, head, body)) AS loss_sha256,
           sum(length(head) + length(body) + 7)::BIGINT AS formatted_chars
    FROM l GROUP BY conv_id
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat.read_back(chat.segments(turns.unionByName(extra)), ordered=True)
