import random

import pytest

#: Columns of ``documents``, and some whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, d string, fp long, words long, size long, key string, pattern string"
EXTRA = (1, "x", 2, 3, 4, "k", "p")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make_texts():
    """Ordinary texts, copies, near copies, shared passages and lines, and every odd case."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(60, 200)) for _ in range(30)]
    passage = words(rng, 120)
    texts = list(base)
    texts += [base[0]] * 3 + [base[1]]
    texts += [base[2].replace("w1", "w2", 1), base[2] + " tail"]
    texts += [words(rng, 30) + "\n" + passage + "\n" + words(rng, 20), passage + " " + words(rng, 9), words(rng, 15) + passage]
    texts += ["The same line of ten words is here to be seen twice\n" + words(rng, 40) for _ in range(4)]
    texts += ["short a\nshort b\n" + words(rng, 12), words(rng, 12) + "\nshort a\nshort b", "short a"]
    texts += [None, None, "", "", " \n\t ", "\n\n", "one", "ONE", "é ß 漢字 🙂", "a" * 2000, "ab" * 900, "x " * 3000]
    texts += ["a\nb\n" * 50, words(rng, 20_000)]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "de" if k % 3 else "en", f"s{k % 4}" if k % 5 else None, len(t or ""), *EXTRA) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[40], (None, texts[3], None, "s1", 5, *EXTRA), (None, None, None, None, None, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
