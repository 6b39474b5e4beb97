"""The corpus operators as queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prepare
from . import bpe, exact_dedup, fingerprints, language_id, mixing, ngram_join, paragraphs, pii, suffix_dedup, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch is written as text, its hashes parted by commas."""
    return fingerprints.fingerprints(documents(spark, sf_dir)).withColumn("sketch", F.array_join("sketch", ","))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.duplicate_paragraphs(documents(spark, sf_dir))


def op5_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(documents(spark, sf_dir), keep=["doc_id"])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact_duplicates(documents(spark, sf_dir), keep=["doc_id"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs), keep=["doc_id"])


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_document_fingerprints": fingerprints.FINGERPRINTS_SQL,
        "op2_source_mixing": mixing.MIXTURE_SQL,
        "op6_exact_dedup": """
SELECT doc_id,
  CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
  text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) > 1 AS is_duplicate
FROM documents""",
        "op9_suffix_array_dedup": suffix_dedup.PASSAGES_SQL,
        "op8_ngram_jaccard_join": ngram_join.NEAR_DUPLICATES_SQL,
    }
