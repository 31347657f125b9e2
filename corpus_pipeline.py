"""From raw documents to token ids: quality, toxicity, near copies, contamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. The first two stages' models can't be stated in
SQL, so ORACLE_SQL is None and the tests compare run() with a plain version.

Defined results: rows with a null or empty text pass the four filters and encode
to no ids; a null doc_id passes near-dedup, which knows documents by their ids,
and is judged by its text elsewhere; rows that repeat a doc_id and text stay or
go together; of equal texts under several ids the smallest id stays, so there
are no ties; columns beyond those of documents pass through all filters,
whatever they are called; an empty table gives an empty result. Without labels
no document is rejected by the first two stages, without benchmark none by the
fourth.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, near_dedup, piece_codec, quality_lm, toxicity
from millrace.llm.queries import PIECES
from millrace.llm.runtime import discard, scratch, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose surprise under the model of trusted text is within their language's cut. Null and empty texts and languages without trusted text stay."""
    return quality_lm.keep_fluent(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 by a model trained on the labelled ones among ``docs`` that are not held out. Empty texts get the score of the intercept."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 0.75 join, the one with the smallest doc_id. Documents without words or without an id stay."""
    return near_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no whole window of 13 words of a benchmark item and less than 1 in 20 words that any item hits."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids, decoded text and spans of every document that is left."""
    return piece_codec.round_trip(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality", drop_low_quality),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encode", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
