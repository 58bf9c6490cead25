"""Quality by importance resampling.

Two generative models over hashed word n-grams, one of target text and one of
the raw corpus, give each document the log ratio of its likelihoods: the sum
over its n-grams, tempered by TEMPER.  Adding seeded Gumbel noise and keeping
the k largest keys samples k documents without replacement in proportion to
their weights: a document's chance of being drawn next is exp(log weight) over
the sum of those not yet drawn.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cleared, drop, free, materialize, small_batches

BUCKETS = 1 << 14
#: The power of the likelihood ratio that documents are drawn by.  Words of a text aren't independent, so that its full
#: ratio is overconfident; at a quarter the noise (of scale 1) matters wherever the ratio is within about e^8 of the edge.
TEMPER = 0.25
CLEAN_WORTH = 5.0

_tokens = re.compile(r"\w+|[^\w\s]+").findall


def buckets(text: str, known: dict[str, int] | None = None) -> np.ndarray:
    """The hashed words and word pairs of a text, repeats included; ``known`` remembers words."""
    known = {} if known is None else known
    if len(known) > 200_000:
        known.clear()
    words = _tokens(text)
    code = np.empty(len(words), dtype=np.int64)
    for k, w in enumerate(words):
        c = known.get(w)
        if c is None:
            c = known[w] = zlib.crc32(w.encode("utf-8"))
        code[k] = c
    pairs = (code[:-1] * 0x9E3779B1 + code[1:] * 0x85EBCA6B) & 0xFFFFFFFF
    return np.concatenate([code % BUCKETS, (pairs ^ (pairs >> 15)) % BUCKETS])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, known = np.zeros((2, BUCKETS), dtype=np.int64), {}
    for b in batches:
        for x, target in zip(b.column(0), b.column(1).to_pylist()):
            got = np.bincount(buckets(x.as_py(), known), minlength=BUCKETS)
            total[0] += got
            if target:
                total[1] += got
    for model in (0, 1):
        at = np.flatnonzero(total[model])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), model, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(total[model][at])], ["model", "bucket", "n"])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket, both smoothed by one."""
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weigh(text: str, ratio: np.ndarray, known: dict[str, int] | None = None, temper: float = TEMPER) -> float:
    """log p_target - log p_raw of the text's n-grams together, times ``temper``; 0 without any."""
    return temper * float(ratio[buckets(text, known)].sum())


def log_weight(ratio: np.ndarray) -> Callable[[Column], Column]:
    """``weigh`` of a column: only the text goes to Python, only the weight comes back."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for b in batches:
            yield pa.array([weigh(x.as_py() or "", ratio, known) for x in b], pa.float64())

    return run


def ordered(key: Column) -> Column:
    """A double as a long of the same order."""
    return F.round(key * float(1 << 32)).cast("long")


def best_edge(known: DataFrame, worth: float = CLEAN_WORTH) -> float:
    """The least weight still kept: most poor rows of ``known(weight, good)`` caught against good rows lost, the latter ``worth`` times.

    As ``quality_forest.threshold`` of the negated weights, but on the
    executors, whatever the number of rows: each of some thousand ranges of
    weights finds its own best cut.
    """
    good, poor = F.sum(F.col("good").cast("long")), F.sum((~F.col("good")).cast("long"))
    known = known.withColumn("range", F.floor(F.asinh("weight") * 64))
    ranges = known.groupBy("range").agg(good.alias("good"), poor.alias("poor")).orderBy(F.desc("range")).collect()
    n_good, n_poor = sum(r["good"] for r in ranges), sum(r["poor"] for r in ranges)
    if not n_good or not n_poor:
        return -math.inf
    above, good_above, poor_above = [], 0, 0
    for r in ranges:
        above.append((r["range"], good_above, poor_above))
        good_above, poor_above = good_above + r["good"], poor_above + r["poor"]
    start = F.broadcast(known.sparkSession.createDataFrame(above, "range long, good_above long, poor_above long"))
    upto = Window.partitionBy("range").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Equal weights share a verdict, so each weight is one row.
    kept = known.groupBy("range", "weight").agg(good.alias("good"), poor.alias("poor")).join(start, "range")
    lost = (n_good - F.col("good_above") - F.sum("good").over(upto)) / n_good
    caught = (n_poor - F.col("poor_above") - F.sum("poor").over(upto)) / n_poor
    last = kept.select("weight", (caught - worth * lost).alias("value")).agg(F.max(F.struct("value", "weight")).alias("best")).first()["best"]["weight"]
    below = known.where(F.col("weight") < last).agg(F.max("weight")).first()[0]
    return last if below is None else (last + below) / 2


def kth_largest(values: DataFrame, c: str, k: int) -> int | None:
    """The k-th largest of the longs in ``c``, by histograms of 4096 bins; the smallest if there are fewer."""
    ends = values.agg(F.min(c), F.max(c), F.count(c)).first()
    low, high, n = ends[0], ends[1], ends[2]
    if not n:
        return None
    k = min(k, n)
    while high > low:
        width = max(1, -(-(high - low + 1) // 4096))
        part = values.where(F.col(c).between(low, high)).groupBy(F.floor((F.col(c) - low) / width).alias("bin")).agg(F.count("*").alias("n"))
        for bin_, count in sorted(((r["bin"], r["n"]) for r in part.collect()), reverse=True):
            if count >= k:
                low, high = low + bin_ * width, min(high, low + (bin_ + 1) * width - 1)
                break
            k -= count
        if width == 1:
            return low
    return low


def gumbel_key(weight: Column, seed: Column, doc_id: Column) -> Column:
    """The log weight plus standard Gumbel noise, which the seed and the id determine."""
    u = F.xxhash64(seed, F.lit("gumbel"), doc_id) / F.lit(2.0**64) + 0.5
    u = F.greatest(F.least(u, F.lit(1 - 1e-12)), F.lit(1e-12))
    return weight - F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 10) -> DataFrame:
    """``docs`` with log_weight, gumbel_key and selected: ``k`` documents sampled by weight against the labelled good texts.

    The raw model counts all of ``docs(doc_id, text)``; the target model counts
    all texts labelled good in ``labels(doc_id, quality)``.  Without ``k`` the
    sample is as large as the number of documents whose weight reaches the value
    that best separates all labelled rows.  selected marks the k largest keys; ties at the edge are all selected.
    All columns of ``docs`` are returned as they are: a result whose name one of
    them has gets an underscore behind it.  Null and empty texts weigh 0.
    Without labels of both kinds, and without ``k``, everything is selected.  A
    repeated id draws the same noise.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    weight, key, selected = (free(c, docs.columns) for c in ("log_weight", "gumbel_key", "selected"))
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Merged whatever the size: the table of labels grows with the documents, and no process has to hold it.
    marked = marked.hint("merge")
    text = F.coalesce("text", F.lit("")).alias("text")
    counted = docs.select("doc_id", text).join(marked, "doc_id", "left").select("text", F.coalesce(F.col("quality") > 0, F.lit(False)).alias("target"))
    counts = cleared(counted.mapInArrow(_count, "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")))
    model = np.zeros((2, BUCKETS))
    for r in counts:
        model[r["model"], r["bucket"]] = r["n"]
    ratio = log_ratio(model[0], model[1])
    weighed = docs.withColumn(weight, log_weight(ratio)(F.col("text")))
    weighed = materialize(weighed.withColumn(key, gumbel_key(F.col(weight), F.lit(seed), F.col("doc_id"))), "weighed")
    if k is None:
        # One weight for each labelled id, however often it is repeated.
        known = weighed.select("doc_id", F.col(weight).alias("weight")).join(marked, "doc_id").groupBy("doc_id").agg(F.min("weight").alias("weight"), (F.min("quality") > 0).alias("good"))
        known = materialize(known.select("weight", "good"), "known")
        edge = best_edge(known)
        drop(known)
        if edge == -math.inf:
            return weighed.withColumn(selected, F.lit(True))
        k = weighed.where(F.col(weight) >= edge).count()
    last = kth_largest(weighed.select(ordered(F.col(key)).alias("key")), "key", k) if k else None
    return weighed.withColumn(selected, F.lit(False) if last is None else ordered(F.col(key)) >= F.lit(last))


def keep_selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``resample`` selects, with their own columns."""
    return resample(docs, labels).where(F.col(free("selected", docs.columns))).select(docs.columns)
