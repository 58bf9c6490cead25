"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if their balls of radius r
meet.  Every distinct fingerprint emits all variants within r flipped bits;
equal variants bring their owners together, and each collision is verified.
The variants of a ball are dealt by a few parities of their bits, and don't
travel: the shuffle carries a fingerprint once for each of the few parts that
its variants fall in, where they are unfolded and meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop, free, group_starts, local_components, materialize, raw_text, small_batches, whole_groups

BITS = 64
#: Fingerprints of each text in the near-dedup stage, each with other hashes: pairs within the distance in any of them are candidates.
PRINTS = 8
#: Variants unfolded at once in one task, and fingerprints whose balls one unfolding takes, about.
AT_ONCE = 1 << 20
CROWD = 512
#: Fingerprints for each part of the shuffle, and bits that name a part, at least: with more of these a fingerprint is sent more often.
PART = 1 << 15
PART_BITS = 4
#: Shingles of the texts in a block, about: larger crowds are compared in pairs of blocks.
MASS = 100_000
#: Cells of the matrices that are multiplied at once.
CELLS = 1 << 22


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Bits set in over half the XXH64 of the text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    hashes = xxhash.xxh64_intdigest
    got = np.array([hashes(joined[s:e], seed) for s, e in zip((end - size)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist())], dtype=np.uint64)
    n, ones = len(got), np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 65_536):
        part = got[k : k + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


def bare_words(text: bytes) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    return [w.strip(b".,;:!?\"'()") or w for w in text.lower().split()]


def _prints_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` fingerprints of one set of hashes: the first of the hashes themselves, the others of mixtures of them."""
    ones = np.zeros(n * BITS, dtype=np.int64)
    for k in range(0, len(hashes), 8192):
        first = hashes[k : k + 8192, None]
        x = first + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        x[:, :1] = first
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def word_prints(n: int, seed: int = 42) -> Callable[[Column], Column]:
    """``n`` fingerprints over the distinct words of a column of bytes; the other columns of its rows don't go to Python."""

    @F.arrow_udf("array<long>")
    def run(text: pa.Array) -> pa.Array:
        one = lambda t: _prints_of(np.array([xxhash.xxh64_intdigest(w, seed) for w in set(bare_words(t))], dtype=np.uint64), n)
        return pa.array([one(x.as_py()) for x in text], pa.list_(pa.int64()))

    return run


def shingle_sets(shingle: int, seed: int = 42) -> Callable[[Column], Column]:
    """Hashes of the distinct word shingles of a column of bytes, of fewer words of the whole sequence."""

    def one(text: bytes) -> np.ndarray:
        w = text.lower().split()
        grams = {b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}
        return np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], dtype=np.uint64).view(np.int64)

    @F.arrow_udf("array<long>")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([one(x.as_py()) for x in text], pa.list_(pa.int64()))

    return run


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x.as_py(), shingle, seed) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return run


def flips(bits: range, most: int) -> np.ndarray:
    """Masks of all ways to flip up to ``most`` of ``bits``."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(bits, k)], dtype=np.uint64)


def blocks(n: int) -> list[int]:
    """The bits of a fingerprint dealt to ``n`` blocks, as masks."""
    return [sum(1 << b for b in range(k, BITS, n)) for k in range(n)]


def parities(fp: np.ndarray, n: int) -> np.ndarray:
    """The parities of the ``n`` blocks of bits, the first one leading.  A flip of one bit flips one of them."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for m in blocks(n):
        out = (out << np.uint64(1)) | (np.bitwise_count(fp & np.uint64(m)) & 1).astype(np.uint64)
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and its fingerprints, from batches that are sorted by part."""
    now, held = None, []
    for b in batches:
        part, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        starts = np.append(group_starts(part), len(part))
        for s, e in zip(starts[:-1], starts[1:]):
            if part[s] != now and held:
                yield now, np.concatenate(held)
                held = []
            now = int(part[s])
            held.append(fp[s:e])
    if held:
        yield now, np.concatenate(held)


def _collide(prefix: int, inner: int, radius: int):
    """Unfold the variants that fall in each part, those of equal ``prefix`` parities at once, and link the owners of equal ones.

    A part has ``inner`` parities of its own; the ones before them are its number.
    There is one link for each fingerprint, to its component in the part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = flips(range(BITS), radius)
        turned = parities(masks, prefix)
        order = np.argsort(turned, kind="stable")
        masks, turned = masks[order], turned[order]
        starts = np.append(group_starts(turned), len(turned))
        ways = {int(turned[s]): masks[s:e] for s, e in zip(starts[:-1], starts[1:])}  # from parities to others that differ so
        for number, fp in _parts(batches):
            own_parities = parities(fp, prefix)
            a, b = [], []
            for at in range(number << inner, (number + 1) << inner):
                differ = own_parities ^ np.uint64(at)
                near = np.flatnonzero(np.bitwise_count(differ) <= radius)
                if len(near) < 2:
                    continue
                near = near[np.argsort(differ[near], kind="stable")]
                starts = np.append(group_starts(differ[near]), len(near))
                crowds = [(near[s:e], ways[int(differ[near[s]])]) for s, e in zip(starts[:-1], starts[1:])]
                parts = -(-sum(len(mine) * len(m) for mine, m in crowds) // AT_ONCE)  # more passes for a crowd, never fewer variants
                for part in range(parts):
                    v, own = [], []
                    for mine, m in crowds:
                        step = max(1, AT_ONCE // len(m))
                        for c in range(0, len(mine), step):
                            x = (fp[mine[c : c + step]][:, None] ^ m[None, :]).ravel()
                            o = np.repeat(mine[c : c + step], len(m))
                            if parts > 1:
                                keep = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts) == part
                                x, o = x[keep], o[keep]
                            v.append(x)
                            own.append(o)
                    v, own = np.concatenate(v), np.concatenate(own)
                    order = np.sort(v)
                    twice = order[1:][order[1:] == order[:-1]]
                    if not len(twice):
                        continue
                    twice = np.unique(twice)
                    spot = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
                    hit = twice[spot] == v
                    spot, own = spot[hit], own[hit]
                    low = np.full(len(twice), np.iinfo(np.int64).max)
                    np.minimum.at(low, spot, own)
                    other = low[spot]
                    # Owners of one variant differ in at most 2 * radius bits; checked all the same.
                    close = (own != other) & (np.bitwise_count(fp[own] ^ fp[other]) <= 2 * radius)
                    a.append(own[close])
                    b.append(other[close])
            if a and len(i := np.concatenate(a)):
                j = np.concatenate(b)
                root = local_components(len(fp), i, j)
                i = np.unique(np.concatenate([i, j]))
                least = np.full(len(fp), np.iinfo(np.uint64).max, dtype=np.uint64)
                np.minimum.at(least, root[i], fp[i])  # the same one for a component, wherever most of it meets
                pairs = np.unique(np.column_stack([fp[i], least[root[i]]]).view(np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


def shared(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many members each set ``one`` has in common with each set ``two``: a product of 0/1 matrices, some columns at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, column = rows[count[column] > 1], column[count[column] > 1]  # what one set has alone is in common with none
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    column = np.cumsum(np.append(False, column[1:] != column[:-1])) if len(column) else column
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    width = max(1, CELLS // len(sets))
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [k, k + width])
        m = np.zeros((len(sets), min(width, int(column[-1]) + 1 - k)), dtype=np.float32)
        m[rows[s:e], column[s:e] - k] = 1
        out += m[one] @ m[two].T
    return out


def _verify(similarity: float):
    """Links of the texts of each block, or of one block with another, that share ``similarity`` of their shingles: each to its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["crowd", "block"], 1):
            row, half = t.column("row").to_numpy(), t.column("half").to_numpy()
            starts = np.append(group_starts(t.column("crowd").to_numpy(), t.column("block").to_numpy()), len(row))
            lists = t.column("s").combine_chunks()
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            a, b = [], []
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s < 2:
                    continue
                sets = [values[ends[k] : ends[k + 1]] for k in range(s, e)]
                size = np.array([len(x) for x in sets])
                within = bool((half[s:e] == 2).any())
                one, two = (np.arange(e - s),) * 2 if within else (np.flatnonzero(half[s:e] == 0), np.flatnonzero(half[s:e] == 1))
                if not len(one) or not len(two):
                    continue
                common = shared(sets, one, two)
                good = common >= similarity * (size[one][:, None] + size[two][None, :] - common)
                x, y = np.nonzero(np.triu(good, 1) if within else good)
                a.append(one[x] + s)
                b.append(two[y] + s)
            if a and len(i := np.concatenate(a)):
                root = local_components(len(row), i, np.concatenate(b))
                i = np.flatnonzero(root != np.arange(len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(row[i]), pa.array(row[root[i]])], ["a", "b"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every whole text, fp as a signed 64-bit integer; null texts count as empty."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", raw_text()).mapInArrow(_fingerprints(shingle, seed), f"doc_id {kind}, fp long")


def link_fingerprints(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) among the distinct values of ``prints.fp`` that connect all at ``distance`` or fewer differing bits.

    ``distance`` is even.  Fingerprints that collide are joined to one of their
    number, so the links have the components of all pairs without listing them.
    """
    radius = distance // 2
    if distance != 2 * radius or radius < 1:
        raise ValueError("the distance is twice the radius of the balls, which is one bit at least")
    distinct = materialize(prints.select("fp").distinct(), "prints")
    n = distinct.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / PART)), PART_BITS, 20))
    inner = int(np.clip(np.ceil(np.log2(max(n, 1) / CROWD)), 8, 26)) - bits
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = reduce(Column.bitwiseOR, [F.shiftleft(F.bit_count(F.col("fp").bitwiseAND(F.lit(int(np.uint64(m).astype(np.int64))))) % 2, bits - 1 - k) for k, m in enumerate(blocks(bits + inner)[:bits])])
    flipped = F.explode(F.array(*[F.lit(int(m)) for m in flips(range(bits), radius)])).alias("flipped")
    spread = distinct.select("fp", own.alias("own"), flipped).select(F.col("own").bitwiseXOR(F.col("flipped")).alias("part"), "fp")
    return spread.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_collide(bits + inner, inner, radius), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs(doc_id, text)``.

    Words are runs of non-white-space after lower-casing A-Z; a shingle is
    ``shingle`` of them (fewer: the whole sequence).  Texts without words, null
    among them, have the fingerprint zero and link like any other.  Documents
    whose fingerprints differ in at most ``distance`` bits link; component_id
    is the smallest doc_id reachable.  Equal fingerprints are searched once, so
    groups of copies cost one row.  A null doc_id takes part, but names a
    component only if no other id does.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    links = materialize(link_fingerprints(prints, distance), "links")
    groups = components(links)
    drop(links)
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = materialize(lowest.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), "low"), "groups")
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = named.join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components: of each node one to the smallest it has, and from its others to that one.

    A node has a link for each part of its variants, or each print, at most.
    """
    stars = links.groupBy("a").agg(F.min("b").alias("low"), F.collect_set("b").alias("others"))
    return stars.select("a", F.col("low").alias("b")).unionByName(stars.select(F.explode("others").alias("a"), F.col("low").alias("b")).where("a != b")).distinct()


def verified_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all texts of a crowd that share ``similarity`` of their shingles; ``sets`` has row, crowd and s.

    Crowds of more than MASS shingles go out as pairs of blocks; a text meets
    each block of its crowd in one group, and no pair leaves the tasks.
    """
    blocks = sets.groupBy("crowd").agg(F.ceil(F.sum(F.size("s")) / MASS).cast("int").alias("blocks")).where("blocks > 1")
    d = sets.join(blocks, "crowd", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    d = d.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    half = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    d = d.select("crowd", (F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")).alias("block"), half.alias("half"), "row", "s")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, "crowd", "block").sortWithinPartitions("crowd", "block").mapInArrow(_verify(similarity), "a long, b long")


def deduplicate(docs: DataFrame, distance: int = 4, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id (null last), of repeated ids any one.

    Texts are brought together by PRINTS fingerprints over their distinct words,
    which change less under edits than those over shingles: unlike texts within
    ``distance`` bits in any of them, and what these connect, are a crowd.  In a
    crowd all texts are compared, in blocks: a link are two that share at least
    ``similarity`` of their distinct ``shingle``-word shingles.  Equal texts,
    null and empty among them, are one from the start.  An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    own = {c: free(c, docs.columns) for c in ("__prints", "__same", "__row")}
    made = {own["__prints"]: word_prints(PRINTS)(raw_text()), own["__same"]: F.xxhash64(text, F.length(text)), own["__row"]: F.monotonically_increasing_id()}
    rows = materialize(docs.withColumns(made), "fingerprints")
    known = rows.select("doc_id", "text", *[F.col(v).alias(k) for k, v in own.items()])
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    lead = known.groupBy(F.col("__prints")[0], "__same").agg(F.min(place).alias("l")).select(F.col("l.row").alias("__row"))
    leads = materialize(known.select("__row", "doc_id", "__prints").join(lead, "__row", "left_semi"), "leads")
    met = []
    for k in range(PRINTS):
        ends = leads.select("__row", F.col("__prints")[k].alias("fp"))
        first = materialize(ends.groupBy("fp").agg(F.min("__row").alias("row")), "firsts")  # a row stands for its fingerprint
        links = contracted(link_fingerprints(ends, distance)).join(first.select(F.col("fp").alias("a"), F.col("row").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("row").alias("y")), "b")
        alike = ends.join(first, "fp").select(F.col("__row").alias("x"), F.col("row").alias("y"))
        met.append(materialize(links.select("x", "y").unionByName(alike).where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")), "met", [first]))
    crowds = components(contracted(reduce(DataFrame.unionByName, met))).select(F.col("node").alias("row"), F.col("component").alias("crowd"))
    drop(*met)
    sets = known.select(F.col("__row").alias("row"), "text").join(crowds, "row").select("row", "crowd", shingle_sets(shingle)(raw_text()).alias("s"))
    sets = materialize(sets, "shingles")
    near = materialize(verified_links(sets, similarity), "near", [sets])
    groups = components(near).withColumnRenamed("node", "__row")
    first = leads.join(groups, "__row").groupBy("component").agg(F.min(place).alias("l")).select("component", F.col("l.row").alias("kept"))
    gone = groups.join(first, "component").where("__row != kept").select("__row")
    kept = leads.select("__row").join(gone, "__row", "left_anti").withColumnRenamed("__row", own["__row"])
    kept = materialize(kept, "kept", [leads, near])
    return rows.join(kept, own["__row"], "left_semi").select(docs.columns)
