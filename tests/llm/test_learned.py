"""Classifiers: exact statistics, held-out accuracy, and that odd input has a defined result."""

import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylog.llm import importance_quality, quality_forest, toxicity_cnn

from .conftest import words


@pytest.fixture(scope="module")
def corpus(spark):
    """Good and poor, clean and toxic texts, most of them labelled."""
    rng = random.Random(3)
    rows, marks = [], []
    for k in range(900):
        text, quality, toxic = words(rng, rng.randrange(60, 300), 3000).replace("w7", "W7") + ".", 1, 0
        if k % 9 == 0:
            quality = 0
            text = text.upper() + "!!" if k % 2 else " ".join(w + "%%%" for w in text.split())
        elif k % 4 == 0:
            toxic = 1
            w = text.split()
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rotten", "foul"]) + rng.choice(["", ".", "ish"])
            text = " ".join(w)
        rows.append((k, text, "en" if k % 2 else "fr"))
        if k % 5:
            marks.append((k, quality, toxic))
    marks += [(1, None, None), (99_999, 1, 1), (None, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_rules(corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in quality_forest.judge(docs, labels).collect()}
    assert len(got) == 900
    poor = [r.kept for i, r in got.items() if i % 9 == 0]
    good = [r.kept for i, r in got.items() if i % 9 and not r.base_failed]
    assert np.mean(poor) <= 0.1 and np.mean(good) >= 0.95


def test_quality_rules_learn_from_all_rows(corpus, monkeypatch):
    for limit in ("GROW_ON", "CALIBRATE_ON"):  # what samples once were bounded by
        monkeypatch.setattr(quality_forest, limit, 5, raising=False)
    docs, labels = corpus
    got = {r.doc_id: (r.kept, r.anomaly) for r in quality_forest.judge(docs, labels).collect()}
    assert np.mean([got[i][0] for i in got if i % 9 == 0]) <= 0.1 and np.mean([got[i][0] for i in got if i % 9]) >= 0.95
    assert {r.doc_id: (r.kept, r.anomaly) for r in quality_forest.judge(docs.repartition(5), labels.repartition(3)).collect()} == got


def test_every_row_grows_a_tree(spark, monkeypatch):
    rows = spark.range(900).select(F.col("id").alias("doc_id"), *[F.lit(60).cast("long").alias(c) for c in quality_forest.BASE], *[(F.col("id") * 1.0).alias(c) for c in quality_forest.RULES])
    seen = []
    kept = quality_forest.Forest.grown
    monkeypatch.setattr(quality_forest.Forest, "grown", lambda trees, sizes: seen.append(sizes) or kept(trees, sizes))
    monkeypatch.setattr(quality_forest, "PER_TREE", 1)
    quality_forest.grow(rows)
    assert sum(seen[0]) == 900
    monkeypatch.setattr(quality_forest, "PER_TREE", 10_000)
    quality_forest.grow(rows)
    assert seen[1] == [900] * quality_forest.TREES


def plain_statistics(t):
    t = t or ""
    w = t.encode().split()
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    hit = {k + o for k, x in enumerate(windows) if windows.count(x) > 1 for o in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_base_statistics(docs, no_labels):
    small = docs.where("text is null or length(text) < 20000")
    got = quality_forest.judge(small, no_labels).collect()
    want = [plain_statistics(r.text) for r in small.collect()]
    assert sorted(tuple(r)[1:6] for r in got) == sorted(want)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed) for r in got)


def test_forest():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 3)), rng.normal(6, 0.1, size=(5, 3))])
    s = quality_forest.Forest(x).anomaly(x)
    assert s[500:].min() > np.quantile(s[:500], 0.95) and 0 < s.min() and s.max() < 1
    assert np.isfinite(quality_forest.Forest(np.zeros((1, 2))).anomaly(np.zeros((3, 2)))).all()
    assert quality_forest.threshold(np.array([1.0, 2, 3]), np.array([True, True, False])) == 2.5
    assert quality_forest.threshold(np.array([1.0]), np.array([True])) == math.inf


def test_importance(corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in importance_quality.resample(docs, labels).collect()}
    assert np.mean([r.selected for i, r in got.items() if i % 9 == 0]) <= 0.1
    assert np.mean([r.selected for i, r in got.items() if i % 9]) >= 0.95
    keys = sorted((r.gumbel_key, r.selected) for r in got.values())
    assert [s for _, s in keys] == sorted(s for _, s in keys)  # the k largest keys, whatever k is


def plain_grams(text):
    w = re.findall(r"\w+|[^\w\s]+", text or "")
    code = [zlib.crc32(x.encode()) for x in w]
    pairs = [(a * 0x9E3779B1 + b * 0x85EBCA6B) % 2**32 for a, b in zip(code, code[1:])]
    return [c % 16384 for c in code] + [(p ^ p >> 15) % 16384 for p in pairs]


def plain_noise(seed, doc_id):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), xxhash.xxh64_intdigest(b"gumbel", h))
    return -math.log(-math.log((h - 2**64 * (h >> 63)) / 2**64 + 0.5))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}


def test_no_text_is_left_in_shuffle_files(corpus, monkeypatch):
    # The texts that the counts shuffled are gone before the weighed table, which holds them again, is written.
    docs, labels = corpus
    before, left = shuffle_files(docs.sparkSession), []
    write = importance_quality.materialize

    def watched(df, name, *more):
        left.append(shuffle_files(docs.sparkSession) - before)
        return write(df, name, *more)

    monkeypatch.setattr(importance_quality, "materialize", watched)
    importance_quality.resample(docs, labels, k=300)
    assert left == [set()]


def test_importance_by_brute_force(corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in importance_quality.resample(docs, labels, k=300).collect()}
    grams = {r.doc_id: plain_grams(r.text) for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id in grams}
    raw, target = Counter(g for x in grams.values() for g in x), Counter(g for i in good for g in grams[i])
    n_raw, n_target = sum(raw.values()) + 16384, sum(target.values()) + 16384
    keys = {}
    for i, x in grams.items():
        weight = 0.25 * sum(math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw) for g in x)
        keys[i] = weight + plain_noise(10, i)
        assert abs(got[i].log_weight - weight) < 1e-6 and abs(got[i].gumbel_key - keys[i]) < 1e-6
    assert {i for i, r in got.items() if r.selected} == set(sorted(keys, key=keys.get)[-300:])
    by_weight = sorted(got.values(), key=lambda r: r.log_weight)[-300:]
    assert any(not r.selected for r in by_weight)  # a sample, and no cut


def test_importance_learns_from_all_labelled_rows(corpus, monkeypatch):
    monkeypatch.setattr(importance_quality, "LABELLED", 30, raising=False)  # what a sample once was bounded by
    docs, labels = corpus
    rows = importance_quality.resample(docs, labels).collect()
    grams = {r.doc_id: plain_grams(r.text) for r in docs.collect()}
    marks = {r.doc_id: r.quality == 1 for r in labels.collect() if r.quality is not None and r.doc_id in grams}
    raw, target = Counter(g for x in grams.values() for g in x), Counter(g for i, good in marks.items() if good for g in grams[i])
    n_raw, n_target = sum(raw.values()) + 16384, sum(target.values()) + 16384
    weight = {i: 0.25 * sum(math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw) for g in x) for i, x in grams.items()}
    assert all(abs(r.log_weight - weight[r.doc_id]) < 1e-6 for r in rows)
    edge = -quality_forest.threshold(-np.array([weight[i] for i in marks]), np.array(list(marks.values())), importance_quality.CLEAN_WORTH)
    assert sum(r.selected for r in rows) == sum(w >= edge for w in weight.values())


def test_best_edge_is_that_of_all_rows(spark):
    rng = np.random.default_rng(18)
    for scale, worth in ((0.1, 1.0), (3.0, 5.0), (400.0, 1.0)):
        good = rng.random(3000) < 0.7
        weight = np.round(rng.normal(np.where(good, 1, -1), 1.5) * scale, 2)  # with equal weights
        known = spark.createDataFrame(list(zip(weight.tolist(), good.tolist())), "weight double, good boolean")
        assert abs(importance_quality.best_edge(known, worth) + quality_forest.threshold(-weight, good, worth)) < 1e-9
    assert importance_quality.best_edge(known.where("good")) == importance_quality.best_edge(known.where("false")) == -math.inf


def test_draws_follow_the_weights(spark):
    """Over many seeds the first, and the first three, of six documents are drawn as sampling without replacement draws them."""
    weight = [0.0, 0.3, 0.7, 1.1, 1.5, 2.0]
    rows = spark.createDataFrame(list(enumerate(weight)), "doc_id long, w double").crossJoin(spark.range(20_000).select(F.col("id").cast("int").alias("seed")))
    keyed = rows.select("seed", "doc_id", importance_quality.gumbel_key(F.col("w"), F.col("seed"), F.col("doc_id")).alias("key"))
    order = keyed.groupBy("seed").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", "doc_id")), False), lambda x: x["doc_id"]).alias("o")).select("o").collect()
    one = Counter(r.o[0] for r in order)
    three = Counter(i for r in order for i in r.o[:3])
    p = np.exp(weight)
    want = np.zeros(6)
    for a, b, c in itertools.permutations(range(6), 3):
        chance = p[a] / p.sum() * p[b] / (p.sum() - p[a]) * p[c] / (p.sum() - p[a] - p[b])
        want[[a, b, c]] += chance
    for i in range(6):
        assert abs(one[i] / 20_000 - p[i] / p.sum()) < 0.015 and abs(three[i] / 20_000 - want[i]) < 0.015


def test_importance_keeps_columns_of_its_own_names(corpus):
    docs, labels = corpus
    named = docs.withColumns({"selected": F.lit("mine"), "Log_Weight": F.lit(7), "quality": F.lit(3)})
    got = importance_quality.resample(named, labels)
    assert got.columns == [*named.columns, "log_weight_", "gumbel_key", "selected_"]
    assert got.where("selected = 'mine' and Log_Weight = 7 and quality = 3").count() == 900 and 0 < got.where("selected_").count() < 900


def test_importance_on_odd_texts(docs, no_labels, spark):
    got = importance_quality.resample(docs, no_labels)
    assert got.columns == [*docs.columns, "log_weight", "gumbel_key", "selected"] and got.where("not selected").count() == 0
    assert got.where("coalesce(trim(text), '') = '' and log_weight != 0").count() == 0
    assert got.count() == docs.count()


@pytest.mark.parametrize("k", [1, 3, 5, 8, 100])
def test_kth_largest(spark, k):
    values = [5, 5, -3, 10**15, 0, 7, 5, -(10**15)]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    assert importance_quality.kth_largest(df, "key", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]


def test_toxicity(corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in toxicity_cnn.score_toxicity(docs, labels).collect()}
    held = {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {i for i, r in got.items() if r.held_out} == held
    toxic = {i for i in held if i % 9 and i % 4 == 0}
    assert np.mean([got[i].predicted for i in toxic]) >= 0.9 and np.mean([got[i].predicted for i in held - toxic]) <= 0.1
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    # The language is no input of the score.
    other = toxicity_cnn.score_toxicity(docs.withColumn("lang", F.lit("de")), labels).collect()
    assert all(abs(r.score - got[r.doc_id].score) < 1e-9 for r in other)


def test_toxicity_learns_from_all_labelled_rows_and_windows(corpus, monkeypatch):
    for limit, n in (("FIT_ON", 30), ("FIT_WINDOWS", 1)):  # what samples once were bounded by
        monkeypatch.setattr(toxicity_cnn, limit, n, raising=False)
    monkeypatch.setattr(toxicity_cnn, "SHARD", 300, raising=False)  # several shards
    docs, labels = corpus
    # Two windows of ordinary words stand before each text: the first window says nothing.
    late = docs.withColumn("text", F.concat(F.lit("w1 w2 w3 " * 170), "text"))
    got = {r.doc_id: r for r in toxicity_cnn.score_toxicity(late, labels).collect()}
    held = {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    toxic = {i for i in held if i % 9 and i % 4 == 0}
    assert np.mean([got[i].predicted for i in toxic]) >= 0.9 and np.mean([got[i].predicted for i in held - toxic]) <= 0.1
    again = toxicity_cnn.score_toxicity(late.repartition(5), labels.repartition(3)).collect()
    assert all(abs(r.score - got[r.doc_id].score) < 1e-6 for r in again)


def test_toxicity_on_odd_texts(docs, no_labels):
    got = toxicity_cnn.score_toxicity(docs, no_labels).collect()
    assert len(got) == docs.count() and all(r.predicted == 0 and r.score < 0.01 for r in got)


def test_gradients():
    rng = np.random.default_rng(1)
    m = toxicity_cnn.TextCNN()
    m.embed = rng.normal(size=m.embed.shape).astype(np.float64)
    m.filters = [f.astype(np.float64) for f in m.filters]
    m.bias = [b.astype(np.float64) for b in m.bias]
    m.out, m.shift = m.out.astype(np.float64), m.shift.astype(np.float64)
    codes = toxicity_cnn.word_codes(b"a b c d e f g h i j k l")[None, :].repeat(2, axis=0)
    codes[1] = codes[1][::-1]
    y, heavy = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        h = []
        for w, f, c in zip(toxicity_cnn.WIDTHS, m.filters, m.bias):
            x = m._look(codes)[:, m._slide(codes.shape[1], w)].reshape(2, -1, w * toxicity_cnn.DIM)
            h.append(np.maximum((x @ f + c).max(axis=1), 0))
        z = np.concatenate(h, axis=1) @ m.out + m.shift[0]
        return float((heavy * (np.logaddexp(0, z) - y * z)).sum() / 2)

    grads = m._gradient(codes, y, heavy)
    for p, g in ((m.filters[1], grads[2]), (m.bias[2], grads[6]), (m.shift, grads[8])):
        at = tuple(rng.integers(0, n) for n in p.shape)
        kept = p[at]
        p[at] = kept + 1e-5
        up = loss()
        p[at] = kept - 1e-5
        down = loss()
        p[at] = kept
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3


def test_empty_tables(empty, no_labels):
    for f in (quality_forest.judge, importance_quality.resample, toxicity_cnn.score_toxicity):
        assert f(empty, no_labels).collect() == []
