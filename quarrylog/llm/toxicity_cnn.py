"""Toxicity by a convolutional text classifier, written and trained in numpy.

Words are hashed into an embedding table; filters of several widths slide over
the embedded text, each keeps its largest response, and a logistic layer
reads those.  The whole text is scored, however long.  All labelled rows teach it,
with their whole texts: they are dealt into shards that learn on the executors
and are averaged.  Scores are calibrated so that the threshold found on
labelled rows is 0.7; thresholds by language are calibrated as well and
returned beside the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, remainder, small_batches

#: About how many windows of labelled texts learn together, in one task's memory; shards are averaged after each round.
SHARD = 10_000
#: Passes over the shards, and epochs of each shard in one of them.
ROUNDS = 3
#: Of so many labelled rows one calibrates, the others are fitted on.
ASIDE = 5
#: What is learned is averaged in integers of this unit, so that the order of sums doesn't matter.
UNIT = 2.0**-32
#: Pieces that the shards' changes are summed in.
PIECES = 64
#: Logits are multiples of 1 / GRID within LIMIT, so that all labelled rows fit a histogram.
GRID = 1024
LIMIT = 64
#: Words of a fitted text that one training step sees: the text is cut into windows of this many words.
WINDOW = 256
#: A word is embedded as the concatenation of a row of each of three tables: by the hash of the word, of its
#: first five bytes and of its first three.  Words that collide in one table differ in the others, and words
#: of one stem share rows.
BUCKETS = 1 << 16
PART = 8
TABLES = 3
DIM = TABLES * PART
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 2
POSITIVE_AT = 0.7

_codes: dict[bytes, int] = {}


def word_codes(text: bytes) -> np.ndarray:
    """Hash of each word, A-Z lower-cased and punctuation at its ends dropped; 0 pads."""
    known = _codes
    if len(known) > 400_000:
        known.clear()
    words = text.lower().split()
    out = np.empty(len(words), dtype=np.int64)
    for k, w in enumerate(words):
        c = known.get(w)
        if c is None:
            x = w.strip(b".,;:!?\"'()[]{}<>*#$%&|-_") or w
            c = known[w] = sum((zlib.crc32(y) % (BUCKETS - 1) + 1) << 16 * k for k, y in enumerate((x, x[:5] + b"\x01", x[:3] + b"\x02")))
        out[k] = c
    return out


def _row(codes: np.ndarray, table: int) -> np.ndarray:
    """Where a word's row of a table is."""
    return (codes >> 16 * table & 0xFFFF) + table * BUCKETS


def windows(codes: np.ndarray) -> np.ndarray:
    """A text's codes in padded windows, which overlap so that every filter sees each of its places whole."""
    if len(codes) <= WINDOW:
        return np.pad(codes, (0, WINDOW - len(codes)))[None, :]
    step = WINDOW - max(WIDTHS) + 1
    return np.stack([np.pad(codes[s : s + WINDOW], (0, max(0, WINDOW - len(codes) + s))) for s in range(0, len(codes), step)])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words' codes of each text as bytes, and how many windows they are, before the other columns."""
    for b in batches:
        codes = [word_codes(x.as_py()) for x in b.column(0)]
        n = [1 if len(c) <= WINDOW else -(-len(c) // (WINDOW - max(WIDTHS) + 1)) for c in codes]
        yield pa.RecordBatch.from_arrays([pa.array([c.astype("<i8").tobytes() for c in codes], pa.binary()), pa.array(n, pa.int64()), *b.columns[1:]], ["codes", "windows", *b.schema.names[1:]])


class TextCNN:
    """Embeddings, filters of WIDTHS, max pooling, one logistic unit; trained by Adam."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.01, (TABLES * BUCKETS, PART)).astype(np.float32)  # words never learned stay near zero
        self.embed[::BUCKETS] = 0
        self.filters = [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.shift]

    def _look(self, codes: np.ndarray) -> np.ndarray:
        """Embeddings, DIM numbers for each code."""
        return np.concatenate([self.embed[_row(codes, k)] for k in range(TABLES)], axis=-1)

    @staticmethod
    def _slide(n: int, w: int) -> np.ndarray:
        return np.arange(n - w + 1)[:, None] + np.arange(w)[None, :]

    def _windows(self, codes: np.ndarray, w: int) -> np.ndarray:
        """(rows, positions, w) views of padded codes."""
        return np.lib.stride_tricks.sliding_window_view(codes, w, axis=1)

    def flat(self) -> np.ndarray:
        """All parameters one after another."""
        return np.concatenate([p.ravel() for p in self.parameters()])

    def fill(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, share: float, fresh: bool = True, seed: list[int] | int = 7) -> None:
        """Multiple-instance training on the windows of each text: a text is as toxic as its most toxic window.

        ``share`` of all labelled texts is toxic; ``fresh`` parameters have learned nothing yet.
        """
        rng = np.random.default_rng(seed)
        owner, parts = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate(texts)
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        m = [np.zeros_like(p) for p in self.parameters()]
        v = [np.zeros_like(p) for p in self.parameters()]
        step, share = 0, max(share, 1e-3)
        heavy = np.where(labels > 0, 0.5 / share, 0.5 / max(1 - share, 1e-3)).astype(np.float32)
        for epoch in range(EPOCHS):
            if fresh and epoch == 0:  # before anything is learned any window of a text may be the one
                pick = np.array([rng.integers(first[k], first[k + 1]) for k in range(len(texts))])
            else:
                s = self.logits_of(parts)
                pick = np.array([first[k] + int(np.argmax(s[first[k] : first[k + 1]])) for k in range(len(texts))])
            for rows in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 64)):
                step += 1
                grads = self._gradient(parts[pick[rows]], labels[rows].astype(np.float32), heavy[rows])
                for p, g, a, b in zip(self.parameters(), grads, m, v):
                    if isinstance(g, tuple):  # the embeddings: only the rows seen
                        at, g = g
                        a[at] = 0.9 * a[at] + 0.1 * g
                        b[at] = 0.99 * b[at] + 0.01 * g * g
                        p[at] -= 0.01 * a[at] / (np.sqrt(b[at]) + 1e-6)
                    else:
                        a += 0.1 * (g - a)
                        b += 0.01 * (g * g - b)
                        p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)

    def _gradient(self, codes: np.ndarray, y: np.ndarray, heavy: np.ndarray) -> list:
        n = len(codes)
        pooled, spots = [], []
        for w, f, c in zip(WIDTHS, self.filters, self.bias):
            x = self._look(codes)[:, self._slide(codes.shape[1], w)].reshape(n, -1, w * DIM)
            z = x @ f + c
            best = z.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(z, best[:, None, :], 1)[:, 0], 0))
            spots.append(best)
        h = np.concatenate(pooled, axis=1)
        logit = h @ self.out + self.shift[0]
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * heavy / n
        dh = (d[:, None] * self.out[None, :]) * (h > 0)
        de_at, de, df, dc = [], [], [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            win = np.take_along_axis(self._windows(codes, w), spots[k][:, :, None], axis=1)  # n, FILTERS, w
            x = self._look(win).reshape(n, FILTERS, w * DIM)
            df.append(np.einsum("nk,nkd->dk", g, x))
            dc.append(g.sum(axis=0))
            back = (g[:, :, None] * f.T[None]).reshape(n, FILTERS, w, DIM)
            back = back.reshape(-1, DIM)
            for j in range(TABLES):
                de_at.append(_row(win.ravel(), j))
                de.append(back[:, j * PART : (j + 1) * PART])
        at, inverse = np.unique(np.concatenate(de_at), return_inverse=True)
        total = np.zeros((len(at), PART), dtype=np.float32)
        np.add.at(total, inverse, np.concatenate(de))
        total += 1e-4 * self.embed[at]
        total[at % BUCKETS == 0] = 0
        return [(at, total), *df, *dc, h.T @ d + 1e-4 * self.out, np.array([d.sum()], dtype=np.float32)]

    def logits_of(self, codes: np.ndarray) -> np.ndarray:
        """One logit for each row of padded codes."""
        out = np.empty(len(codes), dtype=np.float32)
        for s in range(0, len(codes), 512):
            part = codes[s : s + 512]
            e = self._look(part)
            h = []
            for w, f, c in zip(WIDTHS, self.filters, self.bias):
                z = sum(e[:, o : e.shape[1] - w + 1 + o] @ f[o * DIM : (o + 1) * DIM] for o in range(w))
                h.append(np.maximum(z.max(axis=1) + c, 0))
            out[s : s + 512] = np.concatenate(h, axis=1) @ self.out + self.shift[0]
        return out

    def logit(self, codes: np.ndarray) -> float:
        """The logit of a whole text: its filters' largest responses within each window, and of its windows the largest."""
        return float(np.clip(np.rint(float(self.logits_of(windows(codes)).max()) * GRID) / GRID, -LIMIT, LIMIT))


def best_cut(logit: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> float:
    """The cut with the best balanced accuracy, in the middle of the gap it lies in; each row stands for ``times`` rows."""
    order = np.argsort(logit, kind="stable")
    s, t = logit[order], np.where(toxic, times, 0)[order]
    c = np.where(toxic, 0, times)[order]
    below = np.cumsum(c) / max(c.sum(), 1) - np.cumsum(t) / max(t.sum(), 1)
    below[:-1][s[1:] == s[:-1]] = -np.inf
    k = int(np.argmax(below))
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def calibrated(logit: np.ndarray | float, cut: float) -> np.ndarray:
    """A score from 0 to 1 that rises with the logit and is POSITIVE_AT at the cut."""
    return 1 / (1 + np.exp(-np.clip(np.asarray(logit, dtype=np.float64) - cut + np.log(POSITIVE_AT / (1 - POSITIVE_AT)), -60, 60)))


def _score(model: TextCNN, cut: float, by_language: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, flagged = [], []
            for text, lang in zip(b.column(2), b.column(3).to_pylist()):
                z = model.logit(word_codes(text.as_py()))
                score.append(float(calibrated(z, cut)))
                flagged.append(z >= by_language.get(lang, cut))
            s = np.array(score, dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= POSITIVE_AT).astype(np.int32)), pa.array(flagged, pa.bool_())], ["doc_id", "held_out", "score", "predicted", "over_language_threshold"])

    return run


def _train(flat: np.ndarray, share: float, turn: int):
    """Train each shard's texts, which come one after another in order; give the sums of what changed, and how many shards changed it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, times, at, texts, marks = np.zeros(len(flat), dtype=np.int64), np.zeros(len(flat), dtype=np.int64), None, [], []

        def finish() -> None:
            if texts:
                model = TextCNN()
                model.fill(flat)
                model.fit(texts, np.array(marks), share, turn == 0, [7, turn, at])
                moved = np.rint((model.flat().astype(np.float64) - flat) / UNIT).astype(np.int64)
                np.add(total, moved, out=total)
                np.add(times, moved != 0, out=times)

        for b in batches:
            for shard, toxic, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if shard != at:
                    finish()
                    at, texts, marks = shard, [], []
                texts.append(windows(np.frombuffer(x.as_py(), dtype="<i8")))
                marks.append(toxic)
        finish()
        if times.any():
            cut = np.array_split(np.arange(len(flat)), PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), *(pa.array([v[c[0] : c[-1] + 1].tobytes() for c in cut], pa.binary()) for v in (total, times))], ["piece", "total", "times"])

    return run


def _sum(parts: pa.Table) -> pa.Table:
    """The sums of one piece."""
    total, times = (sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in parts.column(c)) for c in ("total", "times"))
    return pa.table({"piece": parts.column("piece").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary())})


def train(coded: DataFrame, shards: int, share: float) -> TextCNN:
    """A model of all texts of ``coded(shard, key, toxic, codes)``: what each shard changes is averaged over those that change it, round by round."""
    model = TextCNN()
    kind = "piece int, total binary, times binary"
    for turn in range(ROUNDS):
        flat = model.flat()
        dealt = coded.repartition(shards, "shard").sortWithinPartitions("shard", "key").select("shard", "toxic", "codes")
        moved = materialize(dealt.mapInArrow(_train(flat, share, turn), kind).groupBy("piece").applyInArrow(_sum, kind), "moved")
        rows = sorted(moved.collect(), key=lambda r: r["piece"])
        drop(moved)
        total, times = (np.concatenate([np.frombuffer(r[c], dtype=np.int64) for r in rows]) for c in ("total", "times"))
        model.fill((flat + total * UNIT / np.maximum(times, 1)).astype(np.float32))
    return model


def _logits(model: TextCNN):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [model.logit(np.frombuffer(x.as_py(), dtype="<i8")) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), b.column(1), b.column(2)], ["z", "toxic", "lang"])

    return run


def _cut_of(language: pa.Table) -> pa.Table:
    """The cut of one language, if it has ten labelled rows of each kind."""
    z, toxic, n = (language.column(c).to_numpy() for c in ("z", "toxic", "n"))
    own = min(n[toxic].sum(), n[~toxic].sum()) >= 10
    return pa.table({"lang": language.column("lang").slice(0, int(own)), "cut": pa.array([best_cut(z, toxic, n)][: int(own)], pa.float64())})


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text[, lang])``, learning from ``labels(doc_id, toxic)``.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out of learning and
    calibration.  Returns doc_id, held_out, score (0 to 1), predicted (1 from
    0.7) and over_language_threshold, the verdict by the threshold calibrated
    for the row's language; lang is no input of the score.  Null and empty texts
    are scored as texts without words.  All other labelled rows and all of their
    windows are used: of ASIDE rows one, by a hash, sets the thresholds, and the
    others are fitted on.  Labels that are null or contradict each other are ignored.
    Without labels of both kinds every score is 0.  Rows that repeat an id are
    learned and scored one by one.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    held = remainder("doc_id", 3) == 1
    marked = labels.where(~held & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    body = F.coalesce("text", F.lit("")).cast("binary")
    place = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "body")
    # Merged whatever the size: the table of labels grows with the documents, and no process has to hold it.
    drawn = docs.where(~held).select("doc_id", body.alias("body"), lang.alias("lang")).join(marked.hint("merge"), "doc_id")
    drawn = drawn.select("body", F.coalesce("lang", F.lit("")).alias("lang"), (F.col("toxic") > 0).alias("toxic"), (F.pmod(place(3), F.lit(ASIDE)) == 0).alias("aside"), place(5).alias("deal"), place(7).alias("key"))
    coded = materialize(drawn.mapInArrow(_encode, "codes binary, windows long, lang string, toxic boolean, aside boolean, deal long, key long"), "coded")
    kind = dict(docs.dtypes)["doc_id"]
    seen = {(r["aside"], r["toxic"]): r for r in coded.groupBy("aside", "toxic").agg(F.count("*").alias("n"), F.sum("windows").alias("w")).collect()}
    model, cut, by_language = TextCNN(), 100.0, {}
    if any(t for _, t in seen) and not all(t for _, t in seen):
        learn, aside = coded.where("not aside"), coded.where("aside")
        used = [r for (a, _), r in seen.items() if not a]
        if not {(True, True), (True, False), (False, True)} <= seen.keys():
            learn, aside, used = coded, coded, list(seen.values())  # too few to set any aside
        shards = -(-sum(r["w"] for r in used) // SHARD)
        share = sum(r["n"] for r in used if r["toxic"]) / sum(r["n"] for r in used)
        model = train(learn.withColumn("shard", F.pmod("deal", F.lit(shards)).cast("int")), shards, share)
        found = aside.select("codes", "toxic", "lang").mapInArrow(_logits(model), "z double, toxic boolean, lang string").groupBy("lang", "z", "toxic").agg(F.count("*").alias("n"))
        found = materialize(found, "logits")
        times = found.groupBy("z", "toxic").agg(F.sum("n").alias("n")).toPandas()
        cut = best_cut(times["z"].to_numpy(), times["toxic"].to_numpy(dtype=bool), times["n"].to_numpy())
        by_language = {r["lang"]: r["cut"] for r in found.groupBy("lang").applyInArrow(_cut_of, "lang string, cut double").collect()}
        drop(found)
    drop(coded)
    scored = docs.select("doc_id", held.alias("held_out"), body.alias("body"), lang.alias("lang"))
    return scored.mapInArrow(_score(model, cut, by_language), f"doc_id {kind}, held_out boolean, score double, predicted int, over_language_threshold boolean")
