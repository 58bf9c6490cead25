"""Quality rules: an isolation forest over rule statistics.

The statistics of every text are measured once.  All rows are dealt to a forest
of random splits, whose trees grow on the executors; rows that few splits
isolate are anomalous.  The verdict's threshold is calibrated on all labelled
rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Every row grows a tree; while rows are few each goes to as many trees as give them PER_TREE rows.
TREES = 128
PER_TREE = 256
#: Splits above a leaf, at most: what the driver gets is bounded by both.
DEEPEST = 12
#: Decimals of an anomaly, so that all labelled rows fit a histogram.
DECIMALS = 5
#: A clean document lost counts as much as so many poor ones kept.
CLEAN_WORTH = 5.0

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["mean_word", "symbols_per_word", "upper_share", "punct_share", "top_word_share", "no_letter_share", "repeat_excess"]
_symbol = re.compile(r"[#*$%&|<>]")
_punct = re.compile(r"[!-/:-@\[-`{-~]")
_letter = re.compile(r"[^\W\d_]").search
_upper = re.compile(r"[^\W\d_a-zà-öø-ÿß]")


def _windows(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows that occur twice or more, and how often the commonest word occurs."""
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    n, base = len(a), len(ids)
    top = int(np.bincount(a).max()) if n else 0
    if n < 4:
        return 0, top
    if base < 1 << 21:
        key = (a[:-2] * base + a[1:-1]) * base + a[2:]
    else:  # pairs first, so that no key overflows
        _, pair = np.unique(a[:-1] * base + a[1:], return_inverse=True)
        key = pair[:-1].astype(np.int64) * base + a[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[inverse] > 1)
    seen = np.zeros(n, dtype=bool)
    for k in range(3):
        seen[hit + k] = True
    return int(seen.sum()), top


def measure(text: str) -> tuple[int, ...]:
    """BASE and RULES of one text."""
    data = text.encode("utf-8")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = len(_symbol.findall(text))
    earlier: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            dup += line in earlier
            earlier.add(line)
    repeat, top = _windows(words)
    m, c = max(n, 1), max(chars, 1)
    return (
        n, chars, symbols, dup, repeat,
        min(chars / m, 12.0), symbols / m, len(_upper.findall(text)) / c, len(_punct.findall(text)) / c, max(top / m, 0.2), sum(_letter(w) is None for w in text.split()) / m, max(repeat / m, 0.4),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = list(zip(*[measure(x.as_py()) for x in b.column(1)])) or [[] for _ in BASE + RULES]
        kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(RULES)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *BASE, *RULES])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, BASE and RULES of every whole text; null counts as empty."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in RULES)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_measure, schema)


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation trees as flat arrays: feature (-1 at a leaf), cut, left child, depth value at leaves."""

    def __init__(self, x: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 8) -> None:
        rng = np.random.default_rng(seed)
        self.norm = float(_expected_path(min(per_tree, len(x)))) or 1.0
        self.trees = [self._grow(x[rng.choice(len(x), min(per_tree, len(x)), replace=False)], rng) for _ in range(trees)]

    @classmethod
    def grown(cls, trees: list[tuple[np.ndarray, ...]], sizes: list[int]) -> Forest:
        """A forest of trees that were grown apart, on so many rows each."""
        forest = cls.__new__(cls)
        forest.trees, forest.norm = trees, float(_expected_path(np.array(sizes)).mean()) or 1.0
        return forest

    @staticmethod
    def _grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        most = min(math.ceil(math.log2(max(len(x), 2))), DEEPEST)
        feature, cut, child, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, level = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            varied = np.flatnonzero(high > low)
            if level >= most or len(rows) <= 1 or not len(varied):
                depth[node] = level + float(_expected_path(len(rows)))
                continue
            f = int(rng.choice(varied))
            c = float(rng.uniform(low[f], high[f]))
            feature[node], cut[node], child[node] = f, c, len(feature)
            below = x[rows, f] <= c
            for part in (rows[below], rows[~below]):
                todo.append((len(feature), part, level + 1))
                feature.append(-1), cut.append(0.0), child.append(0), depth.append(0.0)
        return np.array(feature), np.array(cut), np.array(child), np.array(depth)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over its expectation: near 1 is anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, child, depth in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, child[at] + (x[rows, np.maximum(f, 0)] > cut[at]), at)
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def threshold(score: np.ndarray, good: np.ndarray, worth: float = CLEAN_WORTH, times: np.ndarray | None = None) -> float:
    """The largest score still kept: most poor rows caught against clean rows lost, the latter ``worth`` times; each stands for ``times`` rows."""
    if not good.any() or good.all():
        return math.inf
    order = np.argsort(score, kind="stable")
    n = np.ones(len(score), dtype=np.int64) if times is None else times[order]
    s, g, p = score[order], np.where(good[order], n, 0), np.where(good[order], 0, n)
    lost = (g.sum() - np.cumsum(g)) / g.sum()
    caught = (p.sum() - np.cumsum(p)) / p.sum()
    value = caught - worth * lost
    value[:-1][s[1:] == s[:-1]] = -np.inf  # equal scores share a verdict
    best = int(np.argmax(value))
    return float(s[best]) if best + 1 == len(s) else float((s[best] + s[best + 1]) / 2)


def _grow(rows: pa.Table) -> pa.Table:
    """One tree of its rows, in whatever order they come."""
    tree = rows.column("tree")[0].as_py()
    parts = Forest._grow(np.column_stack([rows.column(c).to_numpy() for c in RULES]), np.random.default_rng([8, tree]))
    kinds = zip(("feature", "cut", "child", "depth"), parts, ("<i1", "<f8", "<i4", "<f8"))
    return pa.table({"tree": pa.array([tree], pa.int32()), "n": pa.array([rows.num_rows], pa.int64())} | {c: pa.array([v.astype(t).tobytes()], pa.binary()) for c, v, t in kinds})


def grow(stats: DataFrame) -> Forest:
    """A forest of all rows of ``stats``: each grows one tree, or as many as give the trees PER_TREE rows."""
    n = stats.count()
    if not n:
        return Forest(np.zeros((1, len(RULES))))
    copies = min(TREES, max(1, -(-TREES * PER_TREE // n)))
    draw = lambda seed: F.xxhash64(F.lit(seed), "doc_id", *BASE, *RULES)
    # An odd step meets every tree once: no row comes twice to a tree.
    trees = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: F.pmod(F.pmod(draw(8), F.lit(TREES)) + j * (2 * F.pmod(draw(9), F.lit(TREES)) + 1), F.lit(TREES)).cast("int"))
    dealt = stats.select(F.explode(trees).alias("tree"), *RULES)
    rows = dealt.groupBy("tree").applyInArrow(_grow, "tree int, n long, feature binary, cut binary, child binary, depth binary").collect()
    rows.sort(key=lambda r: r["tree"])
    read = lambda r: (np.frombuffer(r["feature"], "<i1").astype(np.int64), np.frombuffer(r["cut"], "<f8"), np.frombuffer(r["child"], "<i4").astype(np.int64), np.frombuffer(r["depth"], "<f8"))
    return Forest.grown([read(r) for r in rows], [r["n"] for r in rows])


def _anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    return np.round(np.concatenate([forest.anomaly(x[k : k + 20_000]) for k in range(0, len(x), 20_000)] or [np.zeros(0)]), DECIMALS)


def _anomalies(forest: Forest):
    """(good, RULES) to (good, anomaly)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_anomaly(forest, np.column_stack([c.to_numpy() for c in b.columns[1:]])))], ["good", "anomaly"])

    return run


def _judge(forest: Forest, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy() for k in range(1 + len(BASE), 1 + len(BASE) + len(RULES))]) if b.num_rows else np.zeros((0, len(RULES)))
            s = _anomaly(forest, x)
            n, repeat = b.column(1).to_numpy(), b.column(5).to_numpy()
            failed = (n < 50) | (100 * repeat > 50 * n)
            cols = [b.column(k) for k in range(1 + len(BASE))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(~failed & (s <= most)), pa.array(s)], ["doc_id", *BASE, "base_failed", "kept", "anomaly"])

    return run


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A verdict on every whole text of ``docs(doc_id, text)``, calibrated by ``labels(doc_id, quality)``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than 50 words, or over half of them in repeated 3-word
    windows), kept and anomaly (0 to 1).  Null and empty texts have no words
    and fail.  All rows of 50 words or more grow the trees; the threshold comes
    from all labelled rows that the base rule passes.  Labels that are
    null or of unknown documents are ignored; without both kinds of label only
    the base rule rejects.  Rows that repeat an id are judged on their own.  An
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    stats = materialize(statistics(docs), "statistics")
    forest = grow(stats.where("n_words >= 50"))
    kind = dict(docs.dtypes)["doc_id"]
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").join(marked, "doc_id").select((F.col("quality") > 0).alias("good"), *RULES)
    times = known.mapInArrow(_anomalies(forest), "good boolean, anomaly double").groupBy("good", "anomaly").agg(F.count("*").alias("n")).toPandas()
    most = threshold(times["anomaly"].to_numpy(), times["good"].to_numpy(dtype=bool), times=times["n"].to_numpy()) if len(times) else math.inf
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, anomaly double"
    return stats.mapInArrow(_judge(forest, most), schema)
