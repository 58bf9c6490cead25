"""Operators on whole texts, against plain versions of what they compute."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import functions as F

from quarrylog.llm import byte_bpe, line_suffix, mixing_flow, nce_lm, simhash_ball, suffix_dedup
from quarrylog.llm.common import components, local_components, materialize

from .conftest import words

rows_of = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
key = lambda x: tuple((v is not None, v) for v in x)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def plain_fingerprint(text, shingle=4):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = rows_of(docs)
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    want = [(i, f"{prints[k]:016x}", low.get(find(k))) for k, (i, _) in enumerate(rows)]
    same(simhash_ball.near_duplicates(docs).collect(), want)


def test_near_dedup(docs, spark):
    rows = rows_of(docs)
    kept = simhash_ball.deduplicate(docs)
    assert kept.columns == docs.columns
    left = rows_of(kept)
    first = {}
    for i, t in rows:  # equal texts leave the smallest id, null last
        k = (i is None, i or 0)
        first[t or ""] = min(first.get(t or "", k), k)
    assert len({t or "" for _, t in left}) == len(left) and all(first[t or ""] == (i is None, i or 0) for i, t in left)
    rng = np.random.default_rng(10)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(40)]
    close = [" ".join("new" if k == 77 else w for k, w in enumerate(t.split())) for t in base]
    far = [" ".join("new" if k % 9 == 0 else w for k, w in enumerate(t.split())) for t in base[:10]]
    df = spark.createDataFrame(list(enumerate(base + close + far)), "doc_id long, text string")
    ids = {r.doc_id for r in simhash_ball.deduplicate(df).collect()}
    assert set(range(40)) <= ids and len(ids & set(range(40, 80))) <= 4 and ids >= set(range(80, 90))


def plain_groups(texts, least=0.8):
    """Smallest index of each text's group: all pairs that share ``least`` of their five-word shingles."""
    grams = []
    for t in texts:
        w = t.lower().split()
        grams.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for b in range(len(texts)):
        for a in range(b):
            common = len(grams[a] & grams[b])
            if common >= least * (len(grams[a]) + len(grams[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(texts))]


def test_near_copies_that_meet_in_unlike_company(spark):
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(6):  # one set of words in other orders: one fingerprint, and 0.8 only between some
        words = [f"u{x}" for x in rng.choice(90_000, 120, replace=False)]
        turned = [list(rng.permutation(words)) for _ in range(4)]
        for w in turned + [turned[3], turned[2], turned[1]]:
            at = int(rng.integers(0, 119))
            w[at], w[at + 1] = w[at + 1], w[at]
            texts.append(" ".join(w))
        texts.append(" ".join([*rng.permutation(turned[1]), "added"]))
        texts.append(" ".join([*turned[2], "added"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash_ball.deduplicate(df).collect()} == set(plain_groups(texts))


def test_recall_of_near_copies_at_the_threshold(spark):
    rng = np.random.default_rng(14)
    texts = []
    for k in range(150):
        base = [f"w{x}" for x in rng.integers(0, 3000, 60 + 8 * k)]
        copy = list(base)
        for at in rng.choice(len(base), max(1, round(len(base) * (0.014, 0.018, 0.021)[k % 3])), replace=False):
            copy[at] = f"w{rng.integers(0, 3000)}"
        texts += [" ".join(base), " ".join(copy)]
    want = set(plain_groups(texts))
    assert len(want) <= 170  # most pairs share 0.8 or more
    got = {r.doc_id for r in simhash_ball.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 0.02 * (len(texts) - len(want))


def test_contracted_links_connect_the_same(spark):
    rng = np.random.default_rng(17)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 150, (130, 2))], "a long, b long")
    of = lambda x: sorted(map(tuple, components(x).collect()))
    assert of(simhash_ball.contracted(links)) == of(links)


def test_crowds_are_compared_whole(spark, monkeypatch):
    """Links of crowds in one block and in many connect what all pairs connect."""
    rng = np.random.default_rng(13)
    base = [rng.integers(0, 1 << 60, 50) for _ in range(6)]
    rows = [(k, int(k % 3), sorted({int(x) for x in rng.permutation(base[k % 6])[: rng.integers(40, 51)]} | {int(x) for x in rng.integers(0, 1 << 60, rng.integers(0, 5))})) for k in range(160)]
    rows += [(500, 9, [1]), (501, 9, [1]), (502, 9, []), (503, 8, [2, 3])]
    want = {frozenset((x[0], y[0])) for k, x in enumerate(rows) for y in rows[:k] if x[1] == y[1] and len(set(x[2]) & set(y[2])) >= 0.8 * len(set(x[2]) | set(y[2])) and (x[2] or y[2])}
    groups = {}
    for a, b in map(tuple, want):
        merged = groups.get(a, {a}) | groups.get(b, {b})
        groups |= {x: merged for x in merged}
    assert len(want) > 300
    for mass in (100_000, 700):
        monkeypatch.setattr(simhash_ball, "MASS", mass)
        monkeypatch.setattr(simhash_ball, "CELLS", 2000)
        links = simhash_ball.verified_links(spark.createDataFrame(rows, "row long, crowd long, s array<long>"), 0.8)
        got = {r.node: r.component for r in components(links).collect()}
        assert got == {x: min(g) for x, g in groups.items()}


def test_a_fingerprint_is_sent_a_few_times(spark, monkeypatch):
    def counted(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([0])], ["a", "b"])

        return run

    monkeypatch.setattr(simhash_ball, "_collide", counted)
    prints = np.random.default_rng(19).integers(-(1 << 63), 1 << 63, 5000)
    rows = simhash_ball.link_fingerprints(spark.createDataFrame([(x,) for x in prints.tolist()], "fp long")).agg(F.sum("a")).first()[0]
    assert rows <= 12 * 5000


def test_balls_meet_in_many_parts(spark, monkeypatch):
    """Fingerprints that differ in few bits, dealt to many parts and to one: the same components as all pairs."""
    rng = np.random.default_rng(20)
    flip = lambda x, most: x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, most + 1), replace=False))
    base = [int(rng.integers(0, 1 << 63)) * 2 + 1 for _ in range(40)]
    values = np.array(sorted({flip(base[k % 40], 9) for k in range(700)}), dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = local_components(len(values), *np.nonzero(near))
    want = {frozenset(values[label == k].view(np.int64).tolist()) for k in np.unique(label) if (label == k).sum() > 1}
    df = spark.createDataFrame([(x,) for x in values.view(np.int64).tolist()], "fp long")
    for part, crowd in ((1 << 15, 512), (4, 1)):
        monkeypatch.setattr(simhash_ball, "PART", part)
        monkeypatch.setattr(simhash_ball, "CROWD", crowd)
        groups = {}
        for r in components(simhash_ball.link_fingerprints(df)).collect():
            groups.setdefault(r.component, set()).add(r.node)
        assert {frozenset(g) for g in groups.values()} == want and len(want) > 20


def test_balls_meet_exactly_within_the_distance(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = set()
    for x in base.tolist():
        values.add(x)
        for d in (1, 2, 3, 4, 5, 6):
            values.add(x ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    values = sorted(values)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    got = {r.node: r.component for r in components(simhash_ball.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    linked = set()
    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
                linked |= {a, b}
    assert {int(np.int64(v).astype(np.uint64)) for v in got} == linked
    classes = {}
    for v, s in zip(values, signed):
        if v in linked:
            classes.setdefault(find(v), set()).add(got[s])
    assert all(len(c) == 1 for c in classes.values()) and len({min(c) for c in classes.values()}) == len(classes)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_lines(rows, most=10):
    """Later copies of runs of two lines, or of one line that is long or in two documents: (doc, line) places to delete."""
    docs = sorted({(i is not None, i if i is not None else 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1], x[2]))
    assert len({d[:2] for d in docs}) == len(docs)
    seq = [[(n, line) for n, line in enumerate(t.split("\n")) if line.encode().split()] for *_, t in docs]
    gone, seen, home = [set() for _ in docs], set(), {}
    for d, lines in enumerate(seq):
        for _, line in lines:
            home.setdefault(line, set()).add(d)
    for d, lines in enumerate(seq):
        for k, (n, line) in enumerate(lines):
            for run in ([line], [line, lines[k + 1][1]] if k + 1 < len(lines) else None):
                if run is None or len(run) == 1 and len(line.encode().split()) < most and len(home[line]) == 1:
                    continue
                if tuple(run) in seen:
                    gone[d] |= {m for m, _ in lines[k : k + len(run)]}
                seen.add(tuple(run))
    return {d: g for d, g in zip(docs, gone)}, {d: len(s) for d, s in zip(docs, seq)}


def test_lines(docs):
    rows = rows_of(docs)
    gone, count = plain_lines(rows)
    want = []
    for i, t in rows:
        if t is None:
            want.append((i, None, 0, 0))
            continue
        d = (i is not None, i if i is not None else 0, t)
        want.append((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) if gone[d] else t, count[d], len(gone[d])))
    out = line_suffix.remove_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    same(out.select("doc_id", "text", "n_lines", "n_removed").collect(), want)
    assert any(w[3] for w in want)


def test_short_lines(spark):
    """A short line that two documents have is cut from the later one; one that a single document repeats is left."""
    texts = ["Refrain\nfirst verse\nRefrain\nlast verse\nRefrain", "Share this page\nwords of one", "words of two\nShare this page"]
    out = line_suffix.remove_repeated_lines(spark.createDataFrame([(k, t, f"n{k}", k) for k, t in enumerate(texts)], "doc_id long, text string, n_lines string, __gone long"))
    assert out.columns == ["doc_id", "text", "n_lines", "__gone", "n_lines_", "n_removed"]
    same(out.collect(), [(0, texts[0], "n0", 0, 5, 0), (1, texts[1], "n1", 1, 2, 0), (2, "words of two", "n2", 2, 2, 1)])


def test_long_runs_stay_linear(spark):
    """One document of 20,000 lines twice: doubling and the stretches have a few rows a line, not the square."""
    text, n = "\n".join(f"line {k}" for k in range(20_000)), 20_000
    docs = spark.createDataFrame([(1, text), (2, text + "\nits own end")], "doc_id long, text string")
    ids = materialize(line_suffix.line_ids(docs.select(F.struct(F.col("doc_id").alias("id"), F.lit(0).alias("h")).alias("doc"), "text")), "lines")
    runs = line_suffix.repeated_runs(ids)
    covered = line_suffix.stretches(runs)
    assert runs.count() == n and covered.count() <= n
    assert covered.agg(F.sum(F.col("e") - F.col("s"))).first()[0] == n
    got = {r.doc_id: tuple(r)[1:] for r in line_suffix.remove_repeated_lines(docs).collect()}
    assert got == {1: (text, n, 0), 2: ("its own end", n + 1, n)}


def test_bpe(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.tokenizer(path, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows_of(docs):
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, ids=True)
    same([r[:4] for r in got.collect()], want)
    same(byte_bpe.decode(got, path, public_tokenizers.PATTERN).collect(), [(i, t or "") for i, t in rows_of(docs)])


def test_bpe_keeps_little_in_a_worker():
    """What a worker remembers outlives the stage, beside the workers and the heap of the next one (F1 of FINDINGS_r02.md)."""
    path, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(3)
    byte_bpe.tokenizer(path, public_tokenizers.PATTERN).known.clear()
    run = byte_bpe._run(path, public_tokenizers.PATTERN, True)
    few = [words(rng, 2500, 50) for _ in range(200)]
    new = [" ".join("".join(rng.choices("abcdefghijklmnoprstuw", k=9)) for _ in range(1000)) for _ in range(40)]
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        got = next(run(iter([batch(few)])))
        assert tracemalloc.get_traced_memory()[1] < 42e6  # a million ids: 57 MB as lists of Python's numbers
        before = tracemalloc.get_traced_memory()[0]
        for _ in run(iter([batch(new)])):
            pass
        assert tracemalloc.get_traced_memory()[0] - before < 11e6  # 18 MB with pairs of neighbours as tuples
    finally:
        tracemalloc.stop()
    bpe = byte_bpe.tokenizer(path, public_tokenizers.PATTERN)
    assert got.column(4).to_pylist() == [[int(i) for i in bpe.encode_text(t).split()] for t in few]


def test_bpe_forgets_what_it_no_longer_uses(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 40)
    path, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(4)
    small, large = byte_bpe.ByteBPE(byte_bpe.read_ranks(path), public_tokenizers.PATTERN), byte_bpe.tokenizer(path, public_tokenizers.PATTERN)
    for _ in range(30):
        text = words(rng, 200, 300)
        assert small.encode_text(text) == large.encode_text(text)
        assert len(small.known) <= 40 and len(small.older) <= 40


def test_bpe_on_awkward_strings():
    bpe = byte_bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = np.random.default_rng(6)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", " \n\tab", "éñ漢🙂a1 ", "<|endoftext|>", "'s't're 09"]
    for a in alphabets:
        for n in (1, 2, 7, 300):
            for _ in range(40):
                t = "".join(a[k] for k in rng.integers(0, len(a), n))
                assert bpe.encode_text(t) == " ".join(map(str, other.encode_ordinary(t)))
                assert bpe.decode_text(bpe.encode_text(t)) == t.encode()


def plain_repeats(rows, size):
    body = [(t or "").encode() for _, t in rows]
    count = Counter(b[p : p + size] for b in body for p in range(len(b) - size + 1))
    out = []
    for (i, _), b in zip(rows, body):
        cover = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if count[b[p : p + size]] > 1:
                cover[p : p + size] = b"\x01" * size
        rest = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out.append((i, len(b), len(b) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
    return out


def test_repeated_bytes(docs):
    small = docs.where("text is null or length(text) < 20000")
    for size in (64, 100, 400):
        same(suffix_dedup.remove_repeats(small, size).collect(), plain_repeats(rows_of(small), size))
    kept = suffix_dedup.remove_repeats(small, 400, keep_text=True).where("n_removed = 0").select("doc_id", "kept").collect()
    assert {(r.doc_id, r.kept) for r in kept} <= {(i, t or "") for i, t in rows_of(small)}


def test_repeats_whose_ends_differ(spark):
    rng = np.random.default_rng(7)
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    core = letters(900)
    texts = [letters(50) + core + letters(50), letters(33) + core[100:700], core[:450] + letters(70) + core[450:], core[300:720], core[500:899], letters(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(suffix_dedup.remove_repeats(df, 400).collect(), plain_repeats(rows_of(df), 400))


def test_repeats_of_many_lengths(spark):
    """Pieces a little longer than the threshold: two anchors' cells can span one and the same bytes, which is no repeat."""
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    pieces = [letters(n) for n in rng.integers(40, 300, 300)]
    texts = []
    for p in pieces:
        for _ in range(2):
            s, e = rng.integers(0, 8), len(p) - rng.integers(0, 8)
            texts.append(letters(int(rng.integers(0, 60))) + p[s:e] + letters(int(rng.integers(0, 60))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (64, 80):
        same(suffix_dedup.remove_repeats(df, size).collect(), plain_repeats(rows_of(df), size))


def test_language_model(docs):
    rows = rows_of(docs)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    c = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + 1
    got = nce_lm.score_documents(docs).collect()
    short = lambda r: (r[0], r[1], r[2], r[3], r[4], round(r[5], 6))
    want = [(i, h, len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))) for (i, _), h, ws in zip(rows, held, tokens)]
    same(map(short, got), map(short, want))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def uniform_model():
    prior = np.full(nce_lm.SYMBOLS, 1 / nce_lm.SYMBOLS)
    group = np.arange(nce_lm.SYMBOLS) * 7 % nce_lm.GROUPS
    return prior, group, nce_lm.LogBilinear.fresh(prior, group)


def test_model_is_normalised():
    _, _, model = uniform_model()
    for scale in (1, 400):  # the second can't do without the shift
        model.target *= scale
        model.group_target *= scale
        before = np.random.default_rng(8).integers(0, nce_lm.SYMBOLS, (5, nce_lm.CONTEXT))
        p = np.stack([np.exp(model.log_prob(before, np.full(5, s)).astype(np.float64)) for s in range(nce_lm.SYMBOLS)])
        assert np.allclose(p.sum(axis=0), 1, atol=1e-3)
    # Against the plain formula, for one context.
    h = model.predicted(before[:1]).astype(np.float64)[0]
    z, zg = model.target @ h + model.bias, model.group_target @ h + model.group_bias
    for s in (0, 17, nce_lm.END):
        g = model.group[s]
        want = zg[g] - np.logaddexp.reduce(zg) + z[s] - np.logaddexp.reduce(z[model.group == g])
        assert abs(float(model.log_prob(before[:1], np.array([s]))[0]) - want) < 1e-3 * max(1, abs(want))


def test_scores_do_not_depend_on_what_is_scored_beside():
    prior, group, model = uniform_model()
    model.bias[:] = np.random.default_rng(2).normal(-8, 2, nce_lm.SYMBOLS)
    symbols = np.random.default_rng(9).zipf(1.3, 30_000).astype(np.uint16) % nce_lm.SYMBOLS
    (before, symbol), *_ = nce_lm.positions([symbols.astype(np.uint16)], 40_000)
    log_prob = model.scorer()
    whole = log_prob(before, symbol)
    for size in (1, 7, 500, 9_000):
        for k in (0, 12_345, 20_000):
            assert np.array_equal(log_prob(before[k : k + size], symbol[k : k + size]), whole[k : k + size])
    assert len(log_prob(before[:0], symbol[:0])) == 0


def test_rows_are_summed_by_symbol():
    rng = np.random.default_rng(4)
    rows, values = rng.integers(0, 50, 700), rng.random((700, 18)).astype(np.float32)
    found, sums = nce_lm._sums(rows, values)
    assert np.array_equal(found, np.unique(rows)) and np.allclose(sums, [values[rows == r].sum(axis=0) for r in found], rtol=1e-5)


def test_model_learns():
    prior, group, model = uniform_model()
    symbols = np.tile(np.arange(8, dtype=np.uint16), 2000)
    (before, symbol), *_ = nce_lm.positions([symbols], 500)
    first = model.log_prob(before, symbol).mean()
    training = nce_lm.Training(model.flat, prior, group, [1])
    for _ in range(4):
        training.take(symbols)
    training.learn()
    assert training.seen == 4 * len(symbols) and training.model.log_prob(before, symbol).mean() > first + 2


def test_every_position_has_its_context():
    texts = [np.arange(n, dtype=np.uint16) + 100 * n for n in (1, 2, 7, 40)]
    want = []
    for t in texts:
        padded = [nce_lm.END] * nce_lm.CONTEXT + t.tolist()
        want += [(padded[k - 1 : k - 1 - nce_lm.CONTEXT : -1] if k > nce_lm.CONTEXT else padded[:k][::-1][: nce_lm.CONTEXT], padded[k]) for k in range(nce_lm.CONTEXT, len(padded))]
    for most in (1, 3, 1000):
        got = [(list(b), s) for before, symbol in nce_lm.positions(texts, most) for b, s in zip(before.tolist(), symbol.tolist())]
        assert got == want


def test_scores_do_not_depend_on_the_layout(docs, monkeypatch):
    monkeypatch.setattr(nce_lm, "SHARD", 12_000)  # several shards of this small table
    runs = [{(r.doc_id, r.n_tokens, r.base_score): r.score for r in nce_lm.score_documents(docs.repartition(n)).collect()} for n in (1, 7, 50)]
    for other in runs[1:]:
        assert other.keys() == runs[0].keys() and all(abs(other[k] - v) < 1e-6 for k, v in runs[0].items())


def test_held_out_text_gains(spark):
    """Words that follow each other by a rule: held-out texts score far better than by their counts alone."""
    rng = np.random.default_rng(15)
    rule = rng.integers(0, 300, (300, 3))
    texts = []
    for _ in range(400):
        w = [int(rng.integers(0, 300))]
        for _ in range(200):
            w.append(int(rule[w[-1], rng.integers(0, 3)]))
        texts.append(" ".join(f"w{x}" for x in w))
    got = nce_lm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert gain > 0.5


def plain_targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    target, fixed, total = {}, {}, share * sum(sizes.values())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    while True:
        left = total - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        scale = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if w[s] * scale > most * sizes[s]]
        if not over:
            return fixed | {s: w[s] * scale for s in open_}
        fixed |= {s: most * sizes[s] for s in over}


def test_sources_on_their_own_need_no_flow(spark):
    rng = np.random.default_rng(16)
    for _ in range(30):
        quotas = [int(x) for x in rng.integers(0, 60, 7)]
        patterns = [([s], int(rng.integers(0, 40))) for s in range(4)] + [(sorted({int(x) for x in rng.integers(3, 7, 2)}), int(rng.integers(0, 40))) for _ in range(3)]
        got, whole = mixing_flow.routed_words(patterns, quotas), [sum(f.values()) for f in mixing_flow.route(patterns, quotas)]
        assert got[:3] == whole[:3] and sum(got) == sum(whole)
    many = 70_000  # more patterns than the flow is solved for
    assert mixing_flow.routed_words([([s], 10) for s in range(many)], [15] * many) == [15] * many
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    mixed, table = mixing_flow.mix(df, F.array("source"))
    assert table.count() == 30_000 and mixed.where("taken > 4").count() == 0 and abs(mixed.agg(F.sum("taken")).first()[0] - 90_000) < 30_000


def test_mixing(docs):
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    mixed, table = mixing_flow.mix(docs, F.array("source"), keep=docs.columns)
    target = plain_targets(sizes)
    assert {r.source: r.source_size for r in table.collect()} == dict(sizes)
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in table.collect())
    assert mixed.select("row.*").columns == docs.columns
    out = mixed.collect()
    assert sorted(r.size for r in out) == sorted(len((r.text or "").encode().split()) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies for r in out)
    for s in sizes:
        taken, longest = sum(r.taken for r in out if r.row.source == s), max(r.size for r in out if r.row.source == s)
        assert abs(taken - target[s]) <= longest / 2 + 1
    again, _ = mixing_flow.mix(docs.repartition(5), F.array("source"), keep=["source"])
    same([(r.doc_id, r.taken) for r in out], [(r.doc_id, r.taken) for r in again.collect()])


def test_overlapping_sources(spark):
    from pyspark.sql import functions as F

    rows = [(k, "w " * 10, ["a"] if k % 4 == 0 else ["a", "b"] if k % 4 == 1 else ["b", "c"] if k % 4 == 2 else []) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    mixed, table = mixing_flow.mix(df, F.col("tags"), share=0.75, weights=(1,))
    out = mixed.collect()
    assert all(r.taken == 0 for r in out if r.pattern == "[]") and abs(sum(r.taken for r in out) - 3000) <= 30
    assert max(r.copies for r in out) <= 2 and [r.source for r in table.collect()] == ["a", "b", "c"]


def test_flow_costs():
    flow = mixing_flow.route([((0,), 10), ((0, 1), 10), ((1,), 10)], [15, 15], 2)
    assert [sum(f.values()) for f in flow] == [10, 10, 10] and sum(f.get(0, 0) for f in flow) == 15
    flow = mixing_flow.route([((0,), 10), ((1,), 10)], [20, 5], 2)
    assert flow == [{0: 20}, {1: 5}]
    assert mixing_flow.route([((0,), 10)], [50], 2) == [{0: 20}] and mixing_flow.route([], [], 2) == []
    assert mixing_flow.capped_targets([10, 100, 0], [5, 2, 1], 165, 2) == [20.0, 145.0, 0.0]


def test_empty_tables(empty):
    from pyspark.sql import functions as F

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    frames = [simhash_ball.near_duplicates(empty), simhash_ball.deduplicate(empty), line_suffix.remove_repeated_lines(empty), byte_bpe.encode(empty, path, public_tokenizers.PATTERN), suffix_dedup.remove_repeats(empty), nce_lm.score_documents(empty), *mixing_flow.mix(empty, F.array("source"))]
    assert [f.collect() for f in frames] == [[]] * len(frames)
