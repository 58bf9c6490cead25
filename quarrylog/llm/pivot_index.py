"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its ``nearest`` closest reference points.  Two
vectors meet if they share at least ``shared`` of them: the inverted lists are
kept by combination of ``shared`` pivots, so that a list holds exactly the
vectors whose shared-pivot count suffices.  Vectors that meet are verified by
cosine in double precision, each pair in one list only (that of its smallest
shared combination).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, components, group_starts, in_order, local_components, materialize, whole_groups

#: About how many vectors for each reference point these are taken from (a sample of the index' own rows).
SAMPLE = 2
#: Cosine that two reference points stay below.
APART = 0.7
#: Lists longer than this are verified in pairs of blocks, each pair of blocks a group of its own.
BLOCK = 1024


def pivot_count(n: int) -> int:
    """A power of two near 7 times the cube root of ``n``, so that lists of three pivots stay short; 16 to 16,384 (12 billion vectors)."""
    return int(2 ** np.clip(np.round(np.log2(7 * max(n, 1) ** (1 / 3))), 4, 14))


def nearest_count(pivots: int) -> int:
    """How many pivots describe a vector: 8, and one more for each doubling beyond 256, where near vectors share fewer."""
    return 8 + max(0, int(np.log2(pivots)) - 8)


def reference_points(sample: list[list[float]], dim: int, count: int) -> np.ndarray:
    """Up to ``count`` vectors of the sample, no two nearer than APART; random directions make up the number.

    A crowd of near copies gives one reference point: more would tell its
    members apart by noise, and the links between them would be lost.
    """
    x = unit([v for v in sample if len(v) == dim] or [[1.0] * dim])
    chosen, n = np.empty((count, dim)), 0
    for v in x:
        if n < count and (not n or (chosen[:n] @ v).max() < APART):
            chosen[n], n = v, n + 1
    rest = np.random.default_rng(dim).normal(size=(count - n, dim))
    chosen[n:] = rest / np.linalg.norm(rest, axis=1, keepdims=True)
    return chosen


def unit(rows: list[list[float]]) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that no square overflows."""
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Ids of the closest pivots of each row of ``x``, nearest first."""
    out, step = [], max(1, (1 << 22) // len(pivots))
    for k in range(0, len(x), step):
        far = -(x[k : k + step] @ pivots.T)
        some = np.sort(np.argpartition(far, min(nearest, len(pivots)) - 1, axis=1)[:, :nearest], axis=1)
        order = np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable")
        out.append(np.take_along_axis(some, order, axis=1).astype(np.int32))
    return np.concatenate(out) if out else np.zeros((0, nearest), dtype=np.int32)


def _verify(x: np.ndarray, p: np.ndarray, combo: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which candidates are links that belong to this very list."""
    good = np.einsum("ij,ij->i", x[i], x[j]) >= least
    k = np.flatnonzero(good)
    same = (p[i[k]][:, :, None] == p[j[k]][:, None, :]).any(axis=2)
    common = np.where(same, p[i[k]], np.iinfo(np.int32).max)
    own = (np.sort(common, axis=1)[:, : combo.shape[1]] == combo[i[k]]).all(axis=1)
    good[k[~own]] = False
    return good


def _link_lists(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["lid", "block"]):
            cid = t.column("cid").to_numpy()
            weight = t.column("weight").to_numpy()
            lid, block = t.column("lid").to_numpy(), t.column("block").to_numpy()
            half = t.column("half").to_numpy()
            combo = np.array(t.column("combo").to_pylist(), dtype=np.int32)
            starts = np.append(group_starts(lid, block), len(cid))
            sizes = np.diff(starts)
            dims = t.column("dim").to_numpy()
            links = np.zeros(len(cid), dtype=np.int64)
            ea, eb = [], []
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                at = np.full(len(cid), -1)
                at[rows] = np.arange(len(rows))
                x = unit(t.column("v").take(rows).to_pylist())
                p = np.array(t.column("pivots").take(rows).to_pylist(), dtype=np.int32)
                own = dims[starts[:-1]] == d
                pairs = []
                for s, n in zip(starts[:-1][own], sizes[own]):
                    a = at[s]
                    if n > 64:  # a long list: one matrix product of its halves, or of itself
                        one = np.flatnonzero(half[s : s + n] == 0)
                        two = np.flatnonzero(half[s : s + n] == 1)
                        if len(two):
                            u, v = np.nonzero(x[a + one] @ x[a + two].T >= least - 1e-9)
                            pairs.append((a + one[u], a + two[v]))
                        else:
                            u, v = np.nonzero(np.triu(x[a : a + n] @ x[a : a + n].T >= least - 1e-9, 1))
                            pairs.append((a + u, a + v))
                short = own & (sizes <= 64) & (sizes > 1)
                if short.any():
                    group = np.repeat(np.arange(len(sizes)), sizes)
                    mine = rows[short[group[rows]]]
                    for off in range(1, int(sizes[short].max())):
                        u, v = mine[:-off] if off else mine, mine[off:]
                        ok = (group[u] == group[v]) & ((half[u] != half[v]) | (half[u] == 2))
                        if not ok.any():
                            break
                        pairs.append((at[u[ok]], at[v[ok]]))
                if not pairs:
                    continue
                i, j = (np.concatenate([q[k] for q in pairs]) for k in (0, 1))
                for c in range(0, len(i), 200_000):
                    a, b = i[c : c + 200_000], j[c : c + 200_000]
                    good = _verify(x, p, combo[rows], a, b, least)
                    a, b = rows[a[good]], rows[b[good]]
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    ea.append(a)
                    eb.append(b)
            if not ea or not links.any():
                continue
            root = local_components(len(cid), np.concatenate(ea), np.concatenate(eb))
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(links[hit]), pa.array(cid[root[hit]])], ["cid", "links", "to"])

    return run


def link_vectors(rows: DataFrame, least: float = 0.93, nearest: int | None = None, shared: int = 3, pivots: int | None = None) -> DataFrame:
    """Links and classes of ``rows(vec_id, embedding, label)``; one row for each input row.

    Returns vec_id, n_links, component_id, kept.  A vector that is null,
    empty, zero or holds a null or a non-finite component, or whose id or label
    is null, links with nothing: 0 links, its own component, kept.  Vectors of
    different lengths never link.  Equal vectors of a label are one class: the
    search sees one of them, so groups of copies of any size cost one row.
    Rows that repeat a vec_id, with like or unlike vectors, count as vectors of
    their own.  Further columns are ignored.  An empty table gives an empty
    result.  ``pivots`` and ``nearest`` follow from the number of classes.
    """
    spark = rows.sparkSession
    r = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    # Finite and not zero; a null component makes forall null.
    peak = F.aggregate("v", F.lit(0.0), lambda a, c: a + F.abs(c))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(peak > 0, F.lit(False))
    r = r.withColumn("fine", fine)
    # Classes go by a number that is written with them: ids can repeat with unlike vectors.
    classes = r.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    pivots = pivots or pivot_count(classes.count())
    nearest = nearest or nearest_count(pivots)
    sample = [list(r["v"]) for r in in_order(bounded_sample(classes.select("v"), SAMPLE * pivots, 11, "v").collect())]
    points = spark.sparkContext.broadcast({d: reference_points(sample, d, pivots) for d in {len(v) for v in sample}})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = dict(points.value)
        for b in batches:
            v = b.column(3).to_pylist()
            dims = np.array([len(x) for x in v], dtype=np.int64)
            out = [None] * len(v)
            for d in np.unique(dims):
                if d not in known:  # a length that the sample hasn't
                    known[d] = reference_points([], int(d), pivots)
                at = np.flatnonzero(dims == d)
                for k, q in zip(at, np.sort(nearest_pivots(unit([v[k] for k in at]), known[d], nearest), axis=1).tolist()):
                    out[k] = q
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(dims, pa.int64()), pa.array(out, pa.list_(pa.int32())), b.column(3)], ["label", "cid", "weight", "dim", "pivots", "v"])

    kinds = dict(classes.dtypes)
    index = classes.select("label", "cid", "weight", "v").mapInArrow(describe, f"label {kinds['label']}, cid long, weight long, dim long, pivots array<int>, v array<double>")
    index = materialize(index, "pivots")
    spots = [list(c) for c in combinations(range(nearest), shared)]
    combos = F.transform(F.array(*[F.array(*[F.lit(x) for x in c]) for c in spots]), lambda c: F.transform(c, lambda k: F.get("pivots", k)))
    postings = index.select("label", "dim", "cid", F.xxhash64("pivots").alias("kind"), F.slice("pivots", 1, shared).alias("first"), F.explode(combos).alias("combo"))
    lists = postings.groupBy("label", "dim", "combo").agg(F.count("*").alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high"), F.max(F.col("first") == F.col("combo")).alias("own"))
    # Vectors of one and the same pivot set meet in the list of its smallest combination; in the others all pairs would be found again.
    lists = lists.where("n > 1 and (low != high or own)")
    postings = postings.drop("kind", "first")
    lists = lists.select("label", "dim", "combo", "n", F.xxhash64("label", "dim", "combo").alias("lid"))
    # Lists beyond BLOCK members go out as pairs of blocks: a member meets each block in one group.
    met = postings.join(lists, ["label", "dim", "combo"])
    b = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid", F.lit(5)), b).cast("int")
    met = met.withColumn("blocks", b).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = met.select("cid", "combo", "lid", (low * F.col("blocks") + high).alias("block"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("half"))
    full = met.join(index.select("cid", "weight", "dim", "pivots", "v"), "cid")
    full = full.select("lid", "block", "half", "cid", "weight", "dim", "combo", "pivots", "v")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = full.repartition(parts, "lid", "block").sortWithinPartitions("lid", "block")
    found = materialize(full.mapInArrow(_link_lists(least), "cid long, links long, to long"), "links", [index])
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "cid")
    lowest = classes.select("cid", "rep").join(groups, "cid").groupBy("component").agg(F.min("rep").alias("low"))
    named = groups.join(lowest, "component").select("cid", "low")
    per_class = (
        classes.join(counts, "cid", "left").join(named, "cid", "left")
        .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("low", "rep").alias("component_id"))
    )
    linked = r.where("fine").join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = r.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
