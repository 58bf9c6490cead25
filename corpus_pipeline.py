"""The corpus pipeline: stages over ``documents``, each of which works on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  The result of a stage is written as
Parquet and read again as the next one's input.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.llm import byte_bpe, importance_quality, line_suffix, mixing_flow, simhash_ball
from quarrylog.llm.common import documents, labels, materialize, standing, supersede


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    return importance_quality.keep_selected(docs, labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; n_chars follows."""
    cleaned = line_suffix.remove_repeated_lines(docs)
    return cleaned.select([F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: 80 % of five-word shingles in common."""
    return simhash_ball.deduplicate(docs, distance=4, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as it is taken."""
    mixed, _ = mixing_flow.mix(docs, F.array("source"), keep=docs.columns)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of their decoding."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


_left = threading.local()


def in_turn(*stages: Callable[[SparkSession, DataFrame, str], DataFrame]) -> list[Callable[[SparkSession, DataFrame, str], DataFrame]]:
    """``stages``, each of which first deletes what those before it left in the shared folder, but for tables that its ``docs`` reads.

    Once its result is written, nothing else reads a stage's own tables.  Results
    that are to outlast a later stage unwritten come from the stage itself.
    """

    def turn(k: int, stage: Callable[[SparkSession, DataFrame, str], DataFrame]):
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            left = getattr(_left, "by", {})
            supersede([p for p, n in left.items() if n < k], docs)
            before = standing()
            _left.by = {p: n for p, n in left.items() if p in before}
            try:
                return stage(spark, docs, sf_dir)
            finally:
                _left.by |= dict.fromkeys(standing() - before, k)

        return run

    return [turn(k, stage) for k, stage in enumerate(stages)]


NAMES = ["quality classifier", "line dedup", "near dedup", "mix sources", "tokenize"]
STAGES = list(zip(NAMES, in_turn(quality_classifier, line_dedup, near_dedup, mix_sources, tokenize)))

#: SimHash fingerprints, byte-level BPE and the n-gram models have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, outer, _left.by = documents(spark, sf_dir), getattr(_left, "by", {}), {}
    try:
        for k, (name, stage) in enumerate(STAGES):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), [docs] if k else None)
        supersede(_left.by, docs)
    finally:  # what a caller's own stages left is the caller's
        _left.by = outer
    return docs
