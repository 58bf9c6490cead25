import math
from collections import defaultdict

import numpy as np
import pytest

from quarrylog.llm.pivot_index import link_vectors, nearest_count, nearest_pivots, pivot_count, reference_points, unit

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, v string, weight int"


def brute(rows, least=0.93):
    """n_links and component of each row, by all pairs."""
    good = [k for k, (i, e, lab, *_) in enumerate(rows) if i is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = defaultdict(set)
    for a in good:
        for b in good:
            x, y = rows[a], rows[b]
            if a < b and x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = unit([x[1]])[0], unit([y[1]])[0]
                if u @ v >= least:
                    links[a].add(b), links[b].add(a)
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n), todo.append(n)
        ids = [rows[s][0] for s in seen]
        out.append((r[0], len(links[k]), None if None in ids else min(ids)))
    return out


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = []
    for k in range(600):
        e = centres[k % 40] + rng.normal(size=16) * (0.02 if k % 3 else 1.0)
        rows.append((k, [float(np.float32(x)) for x in e], k % 2, 1, "x", 2))
    rows += [(1000 + k, rows[5][1], 1, 1, "x", 2) for k in range(30)]  # copies
    rows += [(2000, [2 * x for x in rows[5][1]], 1, 1, "x", 2), (2001, rows[5][1], 0, 1, "x", 2), (2002, rows[5][1], None, 1, "x", 2)]
    rows += [(3000, None, 1, 1, "x", 2), (3001, [], 1, 1, "x", 2), (3002, [0.0] * 16, 1, 1, "x", 2), (3003, [float("nan")] * 16, 1, 1, "x", 2), (3004, [1.0] * 15 + [float("inf")], 1, 1, "x", 2), (3005, [1.0] * 15 + [None], 1, 1, "x", 2), (3006, [1.0, 2.0], 1, 1, "x", 2), (3007, [1.0, 2.0], 1, 1, "x", 2), (None, rows[5][1], 1, 1, "x", 2)]
    rows += [rows[7], rows[7]]  # repeated rows are vectors of their own
    rows += [(k, rows[k + 40 if k < 500 else 100][1], k % 2, 1, "x", 2) for k in (0, 1, 2, 3, 8, 9, 560)]  # ids with unlike vectors
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in link_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    want = sorted((i if i is not None else -1, n, c if c is not None else -1, c is None or i == c) for i, n, c in brute(rows))
    found, all_ = sum(g[1] for g in got), sum(w[1] for w in want)
    assert found <= all_ and found >= 0.9 * all_ and len(got) == len(want)
    assert got == want  # near copies this close are all found


def test_ids_with_unlike_vectors(spark):
    e = np.eye(4)
    vectors = [(1, e[0]), (1, e[1]), (2, e[1] + 0.01 * e[2]), (3, e[0] + 0.01 * e[2]), (4, e[1] + 0.02 * e[2])]
    got = link_vectors(spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in vectors], "vec_id long, embedding array<double>, label int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 1, False)]


def near(rng, x, cosine=0.935):
    """For each row one at that cosine from it."""
    n = rng.normal(size=x.shape)
    n -= (n * x).sum(axis=1, keepdims=True) * x
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    return cosine * x + math.sqrt(1 - cosine**2) * n


@pytest.mark.parametrize("pivots", [None, 256, 2048])
def test_recall_at_the_edge(spark, pivots):
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(300, 64)))
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(np.concatenate([x, near(rng, x)]))]
    got = link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), pivots=pivots).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 600
    assert all(r.component_id in (r.vec_id, r.vec_id - 300) for r in got)


@pytest.mark.parametrize("n", [50_000, 3_000_000, 200_000_000, 10**10])
@pytest.mark.parametrize("spread", [None, 0.5])
def test_recall_with_the_pivots_of_large_tables(n, spread):
    """Near vectors share three pivots, whatever the number of pivots that ``n`` vectors get, spread or crowded."""
    rng = np.random.default_rng(5)
    count = pivot_count(n)
    draw = lambda k: unit(rng.normal(size=(k, 64)) if spread is None else rng.normal(size=(50, 64))[rng.integers(0, 50, k)] + spread * rng.normal(size=(k, 64)))
    points = reference_points(draw(2 * count).tolist(), 64, count)
    x = draw(600)
    a, b = (nearest_pivots(v, points, nearest_count(count)) for v in (x, near(rng, x)))
    assert np.mean([len(np.intersect1d(p, q)) >= 3 for p, q in zip(a, b)]) >= 0.95


def test_empty(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pivots():
    assert [pivot_count(n) for n in (0, 500, 51_282, 10**9)] == [16, 64, 256, 8192]
    x = unit([[3.0, 4.0], [1e300, 1e300]])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    assert [nearest_count(p) for p in (16, 256, 512, 16_384)] == [8, 8, 9, 14]
    assert nearest_pivots(x, unit([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]), 2).tolist()[1] == [2, 0]


@pytest.mark.parametrize("n", [1500])
def test_a_long_list_goes_in_blocks(spark, n):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in np.array([1.0, 2, 3, 4]) + rng.normal(size=4) * 1e-3], 0) for k in range(n)]
    got = link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.component_id == 0 for r in got) and sum(r.n_links for r in got) >= 0.9 * n * (n - 1)
    assert max(r.n_links for r in got) <= n - 1
