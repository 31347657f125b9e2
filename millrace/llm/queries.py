"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, licences, near_dedup, piece_codec, quality_lm, syncmers, token_files, toxicity, warc
from .runtime import table

PIECES = "piece_bpe_32k.model"
BYTE_PAIRS = "byte_bpe_50k.json"


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_hash", "_whole")


def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "chars", F.exp("log_perplexity").alias("perplexity"), "surprise", "cut", "rejected")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_PAIRS))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_decontamination": decontamination,
    "op2_near_duplicates": near_duplicate_groups,
    "op3_sentencepiece": sentencepiece,
    "op4_quality": quality,
    "op5_fingerprints": fingerprints,
    "op6_licenses": license_scan,
    "op7_token_files": token_output,
    "op8_html_text": html_extraction,
    "op9_toxicity": toxic,
    "op10_warc": warc_round_trip,
}

PAYLOADS_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
h AS (SELECT payload_digest, payload_bytes, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h USING (payload_digest, payload_bytes)
"""

FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, w, least(13, len(w)) AS span FROM (
        SELECT item_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
    ) WHERE len(w) > 0
), windows AS (
    SELECT item_id, span, w[s : s + span - 1] AS win FROM (SELECT item_id, span, w, unnest(range(1, len(w) - span + 2)) AS s FROM b)
), spans AS (SELECT DISTINCT span FROM b
), grams AS (
    SELECT r, s, span, w[s : s + span - 1] AS win FROM (SELECT r, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM d, spans WHERE len(w) >= span)
), found AS (SELECT r, s, span, item_id FROM grams JOIN windows USING (span, win)
), hit AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + span)) AS p FROM found) GROUP BY r
), items AS (
    SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM found GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

NEAR_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, w[i : i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), linked AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN linked l ON r.other = l.a
)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

ORACLES = {"op1_decontamination": CONTAMINATION_SQL, "op2_near_duplicates": NEAR_SQL, "op10_warc": PAYLOADS_SQL}
