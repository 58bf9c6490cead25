"""Removal of repeated byte strings by distributed prefix doubling.

A position's rank at length 2h is the pair of the ranks, at length h, of the
position and of the one h further on.  Ranks are 64-bit names of the strings,
so equal pairs are equal strings; Spark shuffles the pairs and reranks them,
dropping positions once they are unique, until the length passes the
threshold T.

Most positions are never listed one by one.  Each start p of a T-byte string
belongs to its anchor: the smallest hashed 8-gram in the middle half of the
string.  The anchor depends on the string alone, so equal strings start at
equal distances from equal anchors, and the starts of one anchor form a run.
Ranking goes from runs to cells of 16 starts to single starts:

* the string that all starts of a run (cell) share is unique: none repeats;
* the string that spans all of them occurs twice: every one repeats;
* otherwise the run (cell) is split and ranked at the next length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, raw_text, small_batches

GRAM = 8
CELL = 16
_name = xxhash.xxh64_intdigest


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def anchor_runs(text: bytes, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all starts of ``threshold``-byte strings: (anchor, first start, last start) of each run."""
    n, margin = len(text), threshold // 4
    if n < threshold:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    raw = np.frombuffer(text, dtype=np.uint8)
    gram = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, GRAM)).view("<u8").ravel()
    key = gram * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    width = threshold - 2 * margin - GRAM + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - threshold + 1) + margin
    owner = (np.minimum(behind[start], ahead[start + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return owner[first], first, np.append(first[1:], len(owner)) - 1


def _runs(threshold: int):
    margin = threshold // 4
    far = threshold - margin - GRAM  # the largest distance of a start from its anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            hs, anchor, first, last, core, wide = [], [], [], [], [], []
            for k, x in enumerate(b.column(2)):
                t = x.as_py()
                a, f, e = anchor_runs(t, threshold)
                hs.append(np.full(len(a), k))
                anchor.append(a), first.append(f), last.append(e)
                at = a.tolist()
                core += [_name(t[p - margin : p + GRAM + margin]) for p in at]
                wide += [_name(t[p - far : p - margin + threshold]) if p >= far and p - margin + threshold <= len(t) else None for p in at]
            row = np.concatenate(hs) if hs else np.zeros(0, dtype=np.int64)
            i32 = lambda v: pa.array(np.concatenate(v).astype(np.int32) if v else [], pa.int32())
            gone = np.array([w is None for w in wide], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[row]), pa.array(d[row]), i32(anchor), i32(first), i32(last), pa.array(_signed(core)), pa.array(_signed([w or 0 for w in wide]), mask=gone)],
                ["h", "d", "anchor", "first", "last", "core", "wide"],
            )

    return run


def _cells(threshold: int):
    """Cells of the undecided runs, with rank pairs of what their starts share and of what spans them."""
    half = threshold // 2
    margin = threshold // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            row, cell, first, last, need, c1, c2, w1, w2, none = [], [], [], [], [], [], [], [], [], []
            for k in range(b.num_rows):
                t = b.column(2)[k].as_py()
                for r in b.column(3)[k].as_py():
                    a, asks = r["anchor"], r["need"]
                    for c in range((a - r["last"] - margin) // CELL, (a - r["first"] - margin) // CELL + 1):
                        near = margin + c * CELL  # distances near .. near + CELL - 1 of starts from the anchor
                        lo, hi = max(r["first"], a - near - CELL + 1), min(r["last"], a - near)
                        s, e = a - near, a - near - CELL + 1 + threshold
                        row.append(k), cell.append(c), first.append(lo), last.append(hi), need.append(asks)
                        c1.append(_name(t[s : s + half])), c2.append(_name(t[e - half : e]))
                        s, e = a - near - CELL + 1, a - near + threshold
                        none.append(s < 0 or e > len(t))
                        w1.append(0 if none[-1] else _name(t[s : s + half], 1)), w2.append(0 if none[-1] else _name(t[s:e], 2))
            at, none = np.array(row, dtype=np.int64), np.array(none, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at]), pa.array(d[at]), pa.array(cell, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(need, pa.bool_()), pa.array(_signed(c1)), pa.array(_signed(c2)), pa.array(_signed(w1), mask=none), pa.array(_signed(w2), mask=none)],
                ["h", "d", "cell", "first", "last", "need", "c1", "c2", "w1", "w2"],
            )

    return run


def _starts(threshold: int):
    """The single starts of the undecided cells, with the pair of ranks at half the threshold."""
    half = threshold // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            row, at, need, r1, r2 = [], [], [], [], []
            for k in range(b.num_rows):
                t = b.column(2)[k].as_py()
                for c in b.column(3)[k].as_py():
                    for p in range(c["first"], c["last"] + 1):
                        row.append(k), at.append(p), need.append(c["need"])
                        r1.append(_name(t[p : p + half])), r2.append(_name(t[p + threshold - half : p + threshold]))
            i = np.array(row, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(d[i]), pa.array(at, pa.int32()), pa.array(need, pa.bool_()), pa.array(_signed(r1)), pa.array(_signed(r2))], ["h", "d", "first", "need", "r1", "r2"])

    return run


def covered(spans: list[dict], threshold: int) -> list[tuple[int, int]]:
    """Maximal byte runs under the strings that start in ``spans`` (first, last)."""
    out: list[list[int]] = []
    for s, e in sorted((x["first"], x["last"] + threshold) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``ranked`` whose rank ``by`` occurs at least twice; null ranks are unique."""
    known = ranked.where(" and ".join(f"{c} is not null" for c in by))
    twice = known.groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    # Written first: over an aggregation in its own stage Spark can't split the rows of a hot rank among tasks.
    return ranked.join(materialize(twice, "repeated"), by, "left_semi")


def repeated_starts(docs: DataFrame, threshold: int = 400) -> DataFrame:
    """(h, d, first, last): runs of starts of ``threshold``-byte strings that also start elsewhere.

    ``docs`` has h, d (which name a row; rows equal in both have equal bytes)
    and ``body`` (bytes).
    """
    spans = ["h", "d", "first", "last"]
    runs = materialize(docs.mapInArrow(_runs(threshold), "h long, d long, anchor int, first int, last int, core long, wide long"), "runs")
    live = materialize(repeated(runs, ["core"]), "live-runs", [runs])
    live = materialize(_decide(live, ["wide"]), "split-runs", [live])
    asked = _asked(live, ["core"], ["wide"], ["h", "d", "anchor", "first", "last"])
    asked = materialize(asked.groupBy("h", "d").agg(F.collect_set(F.struct("anchor", "first", "last", "need")).alias("runs")), "asked", [])
    cells = docs.join(asked, ["h", "d"]).select("h", "d", "body", "runs")
    cells = cells.mapInArrow(_cells(threshold), "h long, d long, cell int, first int, last int, need boolean, c1 long, c2 long, w1 long, w2 long")
    cells = materialize(cells, "cells", [asked])
    kept = materialize(repeated(cells, ["cell", "c1", "c2"]), "live-cells", [cells])
    # With the cell in the key: cells of two anchors may span one and the same bytes, which then stand there once.
    kept = materialize(_decide(kept, ["cell", "w1", "w2"]), "split-cells", [kept])
    asked = _asked(kept, ["cell", "c1", "c2"], ["cell", "w1", "w2"], spans)
    asked = materialize(asked.groupBy("h", "d").agg(F.collect_set(F.struct("first", "last", "need")).alias("cells")), "asked", [])
    starts = docs.join(asked, ["h", "d"]).select("h", "d", "body", "cells")
    starts = materialize(starts.mapInArrow(_starts(threshold), "h long, d long, first int, need boolean, r1 long, r2 long"), "starts", [asked])
    single = repeated(starts, ["r1", "r2"]).where("need").select("h", "d", "first", F.col("first").alias("last"))
    return live.where("whole").select(*spans).unionByName(kept.where("need and whole").select(*spans)).unionByName(single)


def _decide(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Whether the string that spans all starts of a row occurs twice: then each of them repeats."""
    known = ranked.where(" and ".join(f"{c} is not null" for c in by))
    twice = known.groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 1").select(*by, F.lit(True).alias("whole"))
    return ranked.join(materialize(twice, "decided"), by, "left").withColumn("whole", F.coalesce("whole", F.lit(False)))


def _asked(ranked: DataFrame, share: list[str], span: list[str], keep: list[str]) -> DataFrame:
    """Rows to rank at the next length: the undecided, which ``need`` it, and a witness of each decided string.

    Undecided starts may repeat starts of decided rows.  Of rows with the same
    spanning string one stands for all, and only where an undecided row shares
    ``share`` with it.
    """
    need = F.col("need") if "need" in ranked.columns else F.lit(True)
    ranked = ranked.withColumn("need", need & ~F.col("whole"))
    # Both sides written first, as in ``repeated``: then Spark can split the rows of what many undecided rows share.
    wanted = materialize(ranked.where("need").select(*share).distinct(), "wanted")
    whole = ranked.where("whole").groupBy(*span).agg(F.min(F.struct(*share, *keep)).alias("r")).select("r.*")
    others = ranked.where("not whole and not need").select(*share, *keep)
    decided = materialize(whole.unionByName(others), "witnesses")
    witness = decided.join(wanted, share, "left_semi").select(*keep, F.lit(False).alias("need"))
    return ranked.where("need").select(*keep, "need").unionByName(witness)


def _cut(threshold: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, count, sha, kept = [], [], [], [], []
            for body, spans in zip(b.column(1), b.column(2)):
                t, out = body.as_py(), covered(spans.as_py() or [], threshold)
                at = [0, *(x for s in out for x in s), len(t)]
                rest = b"".join(t[s:e] for s, e in zip(at[::2], at[1::2]))
                size.append(len(t)), removed.append(len(t) - len(rest)), count.append(len(out)), sha.append(hashlib.sha256(rest).hexdigest())
                if keep_text:  # a cut may fall inside a character
                    kept.append(rest.decode("utf-8", "replace"))
            cols = [b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept)] * keep_text, names + ["kept"] * keep_text)

    return run


def remove_repeats(docs: DataFrame, threshold: int = 400, keep_text: bool = False) -> DataFrame:
    """Drop each byte under a ``threshold``-byte string that also starts anywhere else in ``docs(doc_id, text)``.

    Texts are UTF-8 bytes, null as empty; strings never cross documents, may
    overlap, and are judged on the input.  One row for each input row: doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of what is
    left, and with ``keep_text`` the rest itself.  Rows that repeat an id and a
    text are copies of each other.  An empty table gives an empty result.
    ``threshold`` is at least 64.
    """
    if threshold < 64:
        raise ValueError("the threshold is at least 64 bytes")
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    d = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), d).alias("h"), F.xxhash64(F.lit(7), d, F.coalesce("text", F.lit(""))).alias("d"), raw_text().alias("body"))
    starts = repeated_starts(keyed.select("h", "d", "body"), threshold)
    spans = materialize(starts.groupBy("h", "d").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans", [])
    joined = keyed.join(spans, ["h", "d"], "left").select("doc_id", "body", "spans")
    return joined.mapInArrow(_cut(threshold, keep_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text)
