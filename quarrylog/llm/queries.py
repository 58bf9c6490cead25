"""The contract queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import byte_bpe, importance_quality, line_suffix, mixing_flow, nce_lm, pivot_index, quality_forest, simhash_ball, suffix_dedup, toxicity_cnn
from .common import documents, labels, raw_text


def op1_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.near_duplicates(documents(spark, sf_dir), distance=4, shingle=4)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nce_lm.score_documents(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_suffix.remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), threshold=400)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, sources = mixing_flow.mix(documents(spark, sf_dir), F.array("source"), share=1.5, most=2, weights=(5, 2, 1), keep=["source"])
    target = F.broadcast(sources.withColumnRenamed("source", "s"))
    joined = mixed.join(target, F.col("row.source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = importance_quality.resample(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir))
    return got.select("doc_id", "log_weight", "gumbel_key", "selected")


def training_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2, op5 and op6 hash, by counts that SQL can check: bytes, words and 4-word shingles of every whole text."""
    n_words = mixing_flow.word_count(F.col("text"))
    n_shingles = F.when(n_words > 4, n_words - 3).otherwise(F.least(n_words, F.lit(1)))
    return documents(spark, sf_dir).select("doc_id", F.length(raw_text()).cast("long").alias("n_bytes"), n_words.alias("n_words"), n_shingles.cast("long").alias("n_shingles"))


TRAINING_INPUTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words FROM d)
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, n_words, CASE WHEN n_words > 4 THEN n_words - 3 ELSE least(n_words, 1) END AS n_shingles FROM w
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pivot_near_dedup, op2_simhash_near_dedup, op3_lm_scoring, op4_line_dedup, op5_byte_bpe, op6_suffix_dedup, op7_toxicity, op8_quality_rules, op9_mixing, op10_quality_classifier, training_inputs)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_suffix.ORACLE, "op9_mixing": mixing_flow.ORACLE, "training_inputs": TRAINING_INPUTS}
