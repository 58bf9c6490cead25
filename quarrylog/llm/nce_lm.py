"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

The model predicts a symbol from the vectors of the CONTEXT symbols before it:
position-wise matrices map them to one predicted vector h.  Symbols are the
commonest words, classes of the other words by their last bytes, and the end
of a text; within its class a word has its share of the smoothed counts, and
every class keeps one outcome for words never seen.

Symbols are dealt into GROUPS groups by the words they stand beside.  The
products of h with the vectors of the groups, and with those of the symbols of
one group, go through a softmax each, so a token costs the square root of what
one softmax over all symbols would, and the distribution is normalised.

Counts cover every training document.  Both sets of vectors are trained by
noise-contrastive estimation on the executors.  Documents are dealt by hash
into shards and sorted within them; each of ROUNDS rounds takes its share of
the documents of every shard, starts all shards from the same parameters, and
averages the results as integers.  Shards, order and noise depend on the
documents alone, so the model is the same however the table is partitioned.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, raw_text, remainder, small_batches

CONTEXT = 3
DIM = 16
HEAD = 2047
CLASSES = 2048
SYMBOLS = HEAD + CLASSES + 1
END = SYMBOLS - 1
GROUPS = 64
#: Noise samples of a batch, among symbols and among groups.
NOISE = 32
GROUP_NOISE = 16
BATCH = 2048
#: Each round takes another one of ROUNDS parts of the training documents, and every position of them.
ROUNDS = 4
RATE = 0.15
#: Training tokens in a shard, about, and the most shards: with more tokens shards grow.
SHARD = 4_000_000
MOST_SHARDS = 4096
#: Neighbours that tell symbols apart: the commonest, and one for all others.
BESIDE = 65
#: Positions handled at once: of training, which they cut into batches, and of scoring.
AT_ONCE = 16_384
SCORED_AT_ONCE = 32_768
#: Positions of one group that are scored by one product.
BLOCK = 32
#: Words whose counts every worker holds, at most: the commonest.  Counts of the others are joined.
HELD = 300_000
#: Parameters are summed over shards as multiples of this.
UNIT = 2.0**-30


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for x in b.column(0):
            total.update(x.as_py().lower().split())
            if len(total) > 1_000_000:
                yield out()
                total.clear()
    yield out()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all texts ``training.body``, A-Z lower-cased."""
    return training.select("body").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30).astype(np.float32, copy=False)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` and the sums of their values, whose columns are even in number: two are added at once, as a complex number."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # by radix
    found = rows.take(order)
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    return found.take(first), np.add.reduceat(values.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)


def _draw(edges: np.ndarray, rng: np.random.Generator, n: int) -> np.ndarray:
    return np.minimum(np.searchsorted(edges, rng.random(n), side="right"), len(edges) - 1)


class LogBilinear:
    """Context vectors, position matrices, vectors and biases of symbols and of groups, as one flat float32 array."""

    SHAPES = ((SYMBOLS, DIM), (CONTEXT, DIM, DIM), (SYMBOLS, DIM), (SYMBOLS,), (GROUPS, DIM), (GROUPS,))

    def __init__(self, flat: np.ndarray, group: np.ndarray) -> None:
        self.flat, self.group = flat.astype(np.float32), group
        self.context, self.position, self.target, self.bias, self.group_target, self.group_bias = self._parts(self.flat)

    @classmethod
    def _parts(cls, flat: np.ndarray) -> list[np.ndarray]:
        at, parts = 0, []
        for shape in cls.SHAPES:
            n = math.prod(shape)
            parts.append(flat[at : at + n].reshape(shape))
            at += n
        return parts

    @classmethod
    def fresh(cls, prior: np.ndarray, group: np.ndarray, seed: int = 3) -> LogBilinear:
        rng = np.random.default_rng(seed)
        turn = np.stack([np.eye(DIM)] * CONTEXT) / CONTEXT + rng.normal(0, 0.05, (CONTEXT, DIM, DIM))
        near = lambda n: rng.normal(0, 0.05, (n, DIM))
        parts = [rng.normal(0, 0.3, (SYMBOLS, DIM)), turn, near(SYMBOLS), np.log(prior), near(GROUPS), np.log(np.bincount(group, prior, GROUPS) + 1e-12)]
        return cls(np.concatenate([p.ravel() for p in parts]), group)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return sum(self.context[before[:, j]] @ self.position[j] for j in range(CONTEXT))

    @staticmethod
    def _log_softmax(h: np.ndarray, target: np.ndarray, own: np.ndarray, shift: bool) -> np.ndarray:
        """For blocks of rows ``h``, each against its matrix in ``target``; ``h`` ends in ones, which meet the biases."""
        z = np.matmul(h, target)
        got = z.reshape(-1).take(np.arange(own.size).reshape(own.shape) * z.shape[2] + own)
        if shift:
            top = z.max(axis=2)
            z -= top[:, :, None]
            got -= top
        np.exp(z, out=z)
        return got - np.log(np.matmul(z, np.ones(z.shape[2], dtype=np.float32)))

    def scorer(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """From (symbols before, symbol) of positions to natural log probabilities: of a symbol's group, and of it within the group.

        Positions go in blocks of BLOCK of one group, filled up with zeros: every product has the same shape, so what is
        rounded hardly depends on the positions that stand beside one.
        """
        turned = [self.context @ self.position[j] for j in range(CONTEXT)]
        far = sum(np.sqrt(np.einsum("nd,nd->n", t, t).max()) for t in turned)
        shift = any((np.sqrt(np.einsum("nd,nd->n", q, q)) * far + np.abs(c)).max() > 60 for q, c in ((self.target, self.bias), (self.group_target, self.group_bias)))  # else exp can't overflow
        # The row behind those of the symbols is what stands before no position.
        turned = [np.vstack([np.column_stack([t, np.full(SYMBOLS, j == 0)]), np.zeros((1, DIM + 1))]).astype(np.float32) for j, t in enumerate(turned)]
        members = np.argsort(self.group, kind="stable")
        size = np.bincount(self.group, minlength=GROUPS)
        place = np.empty(SYMBOLS, dtype=np.int64)
        place[members] = np.arange(SYMBOLS) - np.repeat(np.cumsum(size) - size, size)
        target = np.zeros((GROUPS, DIM + 1, size.max()), dtype=np.float32)
        target[:, DIM] = -1e30  # of no symbol
        target[self.group, :, place] = np.column_stack([self.target, self.bias])
        group_target = np.ascontiguousarray(np.column_stack([self.group_target, self.group_bias]).T)
        several = 32  # blocks at once, whose products stay in the cache

        def log_prob(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
            own = self.group.take(symbol)
            order = np.argsort(own.astype(np.uint16), kind="stable")
            n = np.bincount(own, minlength=GROUPS)
            blocks = -(-n // BLOCK)
            of = np.repeat(np.arange(GROUPS), blocks)
            slot = np.arange(len(symbol)) + np.repeat((np.cumsum(blocks) - blocks) * BLOCK - (np.cumsum(n) - n), n)
            dealt = np.full((CONTEXT, len(of) * BLOCK), SYMBOLS, dtype=np.int64)
            for j in range(CONTEXT):
                dealt[j, slot] = before[:, j].take(order)
            at = np.zeros(len(of) * BLOCK, dtype=np.int64)
            at[slot] = place.take(symbol.take(order))
            dealt, at = dealt.reshape(CONTEXT, -1, BLOCK), at.reshape(-1, BLOCK)
            got = np.empty((len(of), BLOCK), dtype=np.float32)
            for k in range(0, len(of), several):
                b = slice(k, k + several)
                h = turned[0].take(dealt[0, b], axis=0)
                for j in range(1, CONTEXT):
                    h += turned[j].take(dealt[j, b], axis=0)
                mine = np.broadcast_to(of[b, None], at[b].shape)
                got[b] = self._log_softmax(h, group_target, mine, shift) + self._log_softmax(h, target.take(of[b], axis=0), at[b], shift)
            out = np.empty(len(symbol), dtype=np.float32)
            out[order] = got.reshape(-1).take(slot)
            return out

        return log_prob

    def log_prob(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.scorer()(before, symbol)


class Training:
    """Adagrad steps of noise-contrastive estimation from given parameters; the noise is shared by a batch."""

    def __init__(self, flat: np.ndarray, prior: np.ndarray, group: np.ndarray, seed: list[int]) -> None:
        self.model = LogBilinear(flat, group)
        self.rng = np.random.default_rng(seed)
        shares = np.bincount(group, prior, GROUPS) + 1e-12
        self.edges, self.group_edges = np.cumsum(prior) / prior.sum(), np.cumsum(shares) / shares.sum()
        self.log_kq, self.group_log_kq = np.log(NOISE * prior).astype(np.float32), np.log(GROUP_NOISE * shares).astype(np.float32)
        self.squares = LogBilinear._parts(np.full(len(flat), 1e-4, dtype=np.float32))
        self.seen, self.held, self.waiting = 0, [], 0

    @staticmethod
    def _move(part: np.ndarray, squares: np.ndarray, at: np.ndarray | slice, grad: np.ndarray) -> None:
        """Adagrad on the rows ``at``."""
        total = grad * grad
        total += squares[at]
        squares[at] = total
        total += 1e-8
        part[at] -= RATE * grad / np.sqrt(total, out=total)

    @staticmethod
    def _contrast(h: np.ndarray, target: np.ndarray, bias: np.ndarray, symbol: np.ndarray, noise: np.ndarray, log_kq: np.ndarray) -> tuple:
        """Gradients: of ``h``, and of vectors and biases at the rows that real and noise samples name."""
        n, q, qn = len(symbol), target.take(symbol, axis=0), target.take(noise, axis=0)
        real = (_sigmoid(np.einsum("nd,nd->n", h, q) + bias.take(symbol) - log_kq.take(symbol)) - 1) / np.float32(n)
        fake = h @ qn.T
        fake += bias.take(noise) - log_kq.take(noise)
        fake = _sigmoid(fake)
        fake /= np.float32(n)
        values = np.zeros((n + len(noise), DIM + 2), dtype=np.float32)
        np.multiply(real[:, None], h, out=values[:n, :DIM])
        values[:n, DIM] = real
        values[n:, :DIM], values[n:, DIM] = fake.T @ h, fake.sum(axis=0)
        at, sums = _sums(np.concatenate([symbol, noise]), values)
        q *= real[:, None]
        q += fake @ qn
        return q, at, sums[:, :DIM], sums[:, DIM]

    def step(self, before: np.ndarray, symbol: np.ndarray) -> None:
        m, (s_context, s_position, s_target, s_bias, s_group, s_group_bias) = self.model, self.squares
        r = [m.context.take(before[:, j], axis=0) for j in range(CONTEXT)]
        h = sum(r[j] @ m.position[j] for j in range(CONTEXT))
        dh, at, d_target, d_bias = self._contrast(h, m.target, m.bias, symbol, _draw(self.edges, self.rng, NOISE), self.log_kq)
        more, groups, d_group, d_group_bias = self._contrast(h, m.group_target, m.group_bias, m.group[symbol], _draw(self.group_edges, self.rng, GROUP_NOISE), self.group_log_kq)
        dh += more
        seen, d_context = _sums(before.T.ravel(), np.concatenate([dh @ m.position[j].T for j in range(CONTEXT)]))
        d_position = np.stack([r[j].T @ dh for j in range(CONTEXT)])
        self._move(m.context, s_context, seen, d_context)
        self._move(m.position, s_position, slice(None), d_position)
        self._move(m.target, s_target, at, d_target)
        self._move(m.bias, s_bias, at, d_bias)
        self._move(m.group_target, s_group, groups, d_group)
        self._move(m.group_bias, s_group_bias, groups, d_group_bias)

    def take(self, symbols: np.ndarray) -> None:
        """One text's symbols; what is learned depends on the sequence of texts only."""
        self.held.append(symbols)
        self.waiting += len(symbols)
        if self.waiting >= AT_ONCE:
            self.learn()

    def learn(self) -> None:
        for before, symbol in positions(self.held, BATCH):
            self.step(before, symbol)
        self.seen, self.held, self.waiting = self.seen + self.waiting, [], 0


class Known(dict):
    """Numbers of words; any other word is learned as -1 - its class."""

    MOST = 900_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.MOST:
            for w in [w for w, c in self.items() if c < 0]:
                del self[w]
        c = self[word] = -1 - word_class(word)
        return c

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _symbols(codes: np.ndarray, symbol_of: np.ndarray) -> np.ndarray:
    """Symbols of a text's words and its end."""
    out = np.full(len(codes) + 1, END, dtype=np.uint16)
    out[:-1] = np.where(codes >= 0, symbol_of[np.maximum(codes, 0)], HEAD - 1 - codes)
    return out


def positions(texts: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(the CONTEXT symbols before, nearest first; symbol) of every position of the texts, up to ``most`` at once.

    Before a text's first symbol stands the end.
    """
    if not texts:
        return
    lead = np.full(CONTEXT, END, dtype=np.uint16)
    joined = np.concatenate([x for t in texts for x in (lead, t)])
    size = np.array([len(t) for t in texts])
    at = np.arange(size.sum()) + np.repeat(np.arange(1, len(texts) + 1) * CONTEXT, size)
    for k in range(0, len(at), most):
        p = at[k : k + most]
        yield np.column_stack([joined[p - 1 - j] for j in range(CONTEXT)]).astype(np.int64), joined[p].astype(np.int64)


def _encode(head: list[bytes]):
    """(part, shard, key, body) to (part, shard, key, symbols as two bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = Known((w, k) for k, w in enumerate(head)), np.arange(max(len(head), 1))
        for b in batches:
            codes = [_symbols(known.codes(x.as_py().lower().split()), own).astype("<u2").tobytes() for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(codes, pa.binary())], ["part", "shard", "key", "codes"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each symbol stands after, and before, each of the BESIDE commonest and the rest: (cell, n)."""
    total = np.zeros(2 * SYMBOLS * BESIDE, dtype=np.int64)
    for b in batches:
        for x in b.column(0):
            s = np.frombuffer(x.as_py(), dtype="<u2").astype(np.int64)
            round_ = np.concatenate([[END], s, [END]])
            of = np.where(round_ == END, BESIDE - 1, np.minimum(round_, BESIDE - 1))
            for side, c in enumerate((of[:-2], of[2:])):
                np.add(total, np.bincount((s * 2 + side) * BESIDE + c, minlength=len(total)), out=total) if len(s) > 50_000 else np.add.at(total, (s * 2 + side) * BESIDE + c, 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])


def grouped(cells: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Groups of equal size of symbols that stand beside alike ones: halves along the main axis of their vectors, again and again."""
    m = cells.reshape(SYMBOLS, 2 * BESIDE) + 0.1
    ppmi = np.maximum(np.log(m * m.sum() / m.sum(axis=1, keepdims=True) / m.sum(axis=0, keepdims=True)), 0)
    _, axes = np.linalg.eigh(ppmi.T @ ppmi)
    x = ppmi @ axes[:, -DIM:]
    group = np.zeros(SYMBOLS, dtype=np.int64)
    parts = [np.arange(SYMBOLS)]
    while len(parts) < GROUPS:
        halves = []
        for ids in parts:
            weight = prior[ids] ** 0.5
            y = x[ids] - np.average(x[ids], axis=0, weights=weight)
            along = np.linalg.eigh((y * weight[:, None]).T @ y)[1][:, -1]
            order = ids[np.argsort(np.round(y @ along, 9), kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    for g, ids in enumerate(parts):
        group[ids] = g
    return group


def _train(flat: np.ndarray, prior: np.ndarray, group: np.ndarray, turn: int):
    """Train each shard's texts, which come one after another in order; give the sum of the parameters, and at -1 of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shards, at, now = np.zeros(len(flat), dtype=np.int64), 0, None, None

        def finish() -> None:
            nonlocal total, shards
            if now is not None:
                now.learn()
                total += np.rint(np.clip(now.model.flat.astype(np.float64), -(2.0**20), 2.0**20) / UNIT).astype(np.int64)
                shards += 1

        for b in batches:
            for shard, x in zip(b.column(0).to_pylist(), b.column(1)):
                if shard != at:
                    finish()
                    at, now = shard, Training(flat, prior, group, [turn, shard])
                now.take(np.frombuffer(x.as_py(), dtype="<u2"))
        finish()
        if shards:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat), dtype=np.int32)), pa.array(np.concatenate([[shards], total]))], ["k", "v"])

    return run


def shard_count(tokens: int) -> int:
    return int(np.clip(-(-tokens // SHARD), 1, MOST_SHARDS))


def train(coded: DataFrame, shards: int, prior: np.ndarray, group: np.ndarray, rounds: int = ROUNDS) -> LogBilinear:
    """Parameters averaged over the shards of ``coded(part, shard, key, codes)``, round by round."""
    model = LogBilinear.fresh(prior, group)
    for turn in range(rounds):
        dealt = coded.where(F.col("part") == turn).repartition(shards, "shard").sortWithinPartitions("shard", "key").select("shard", "codes")
        rows = dealt.mapInArrow(_train(model.flat.copy(), prior, group, turn), "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        if len(rows):
            v = rows.sort_values("k")["v"].to_numpy()
            model.flat[:] = v[1:] * UNIT / v[0]
    return model


def _score(flat: np.ndarray, group: np.ndarray, head: list[bytes], held, log_total: float, log_end: float, log_mass: np.ndarray, end_known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_prob = LogBilinear(flat, group).scorer()
        common, log_of = held.value
        known = Known((w, k) for k, w in enumerate(common))
        symbol_of = np.array([k if k < len(head) else HEAD + word_class(w) for k, w in enumerate(common)] or [END], dtype=np.int64)
        task, index = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                n_tokens, n_known, base, extra, words_out, times_out, symbols = [], [], [], [], [], [], []
                for x in part.column(2):
                    words = x.as_py().lower().split()
                    codes = known.codes(words)
                    sym = _symbols(codes, symbol_of)
                    rare = [words[k] for k in np.flatnonzero(codes < 0).tolist()]
                    logs = log_of[codes[codes >= 0]]
                    in_class = log_of[codes[codes >= len(head)]]
                    classes = sym[:-1][sym[:-1] >= HEAD] - HEAD
                    n_tokens.append(len(words) + 1)
                    n_known.append(len(logs) + end_known)
                    base.append(float(logs.sum()) + log_end - (len(words) + 1) * log_total)
                    extra.append(float(in_class.sum() - log_mass[classes].sum()))
                    times = Counter(rare)
                    words_out.append(list(times.keys()))
                    times_out.append(list(times.values()))
                    symbols.append(sym)
                score = np.array(extra)
                if symbols:
                    lp = np.concatenate([log_prob(*p) for p in positions(symbols, SCORED_AT_ONCE)]).astype(np.float64)
                    score = score + np.add.reduceat(lp, np.cumsum([0, *map(len, symbols[:-1])])) / math.log(10)
                rid = task + index + np.arange(part.num_rows)
                index += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), part.column(0), part.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(words_out, pa.list_(pa.binary())), pa.array(times_out, pa.list_(pa.int64()))],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"],
                )

    return run


def score_documents(docs: DataFrame, modulus: int = 7, out: int = 2) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text)``; null texts are empty.

    Learns from documents whose crc32(doc_id as text) mod ``modulus`` isn't
    ``out`` (a null id: of the empty text).  Tokens are words with A-Z
    lower-cased and one end.  Returns doc_id, held_out, n_tokens, n_known (seen
    in training), train_tokens, base_score (log10 of the add-one unigram
    probability) and score (log10 probability under the model, normalised over
    the symbols, and within a class over its words and one unseen word).  An
    empty text scores its end.  Rows that repeat an id are scored one by one.
    Without any training document all counts are 0 and the model knows nothing.
    An empty table gives an empty result.  The scores don't depend on how the
    table is partitioned, but for the last digits of sums (1e-6 at most), and
    between machines for what their matrix products round differently.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select("doc_id", (remainder("doc_id", modulus) == out).alias("held_out"), raw_text().alias("body"))
    training = base.where("not held_out")
    counts = materialize(word_counts(training), "word-counts")
    n_docs = training.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = int(sums[0]) + n_docs, int(sums[1]) + (n_docs > 0)
    # The commonest words: counts at or above an edge, found from a histogram of an eighth of an octave a bin.
    fine = F.floor(F.log2("c") * 8).cast("int")
    edge, upto = 0, 0
    for r in counts.groupBy(fine.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():
        edge, upto = r["b"] if upto + r["n"] <= HELD else edge, upto + r["n"]
        if upto > HELD:
            edge = r["b"] + 1
            break
    common = counts.where(fine >= edge).toPandas()
    common = common.assign(word=common["word"].map(bytes)).sort_values(["c", "word"], ascending=[False, True], kind="stable")
    head = common["word"].head(HEAD).tolist()
    held = spark.sparkContext.broadcast((common["word"].tolist(), np.log10(common["c"].to_numpy() + 1.0)))
    suffix = F.when(F.length("word") <= 3, F.col("word")).otherwise(F.substring("word", -3, 3))
    mass = np.ones(CLASSES)
    for r in counts.groupBy((F.crc32(suffix) % CLASSES).alias("class")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["class"]] += r["m"]
    for w, c in zip(head, common["c"]):
        mass[word_class(w)] -= c + 1
    prior = np.concatenate([common["c"].head(HEAD), np.zeros(HEAD - len(head)), mass - 1, [n_docs]]).astype(np.float64) + 1
    prior /= prior.sum()
    shards = shard_count(total)
    place = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "body")
    parted = training.select(F.pmod(place(3), F.lit(ROUNDS)).cast("int").alias("part"), F.pmod(place(5), F.lit(shards)).cast("int").alias("shard"), place(7).alias("key"), "body")
    coded = materialize(parted.mapInArrow(_encode(head), "part int, shard int, key long, codes binary"), "coded")
    cells = np.zeros(2 * SYMBOLS * BESIDE)
    beside = coded.select("codes").mapInArrow(_neighbours, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells[beside["cell"].to_numpy()] = beside["n"].to_numpy()
    group = grouped(cells, prior)
    model = train(coded, shards, prior, group)
    drop(coded)
    run = _score(model.flat, group, head, held, math.log10(total + distinct + 1), math.log10(n_docs + 1), np.log10(mass), int(n_docs > 0))
    schema = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, words array<binary>, times array<long>"
    scored = materialize(base.mapInArrow(run, schema), "scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where(fine < edge), "word")
    rare = rare.groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"))
    joined = scored.drop("words", "times").join(rare, "rid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
