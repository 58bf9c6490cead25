"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong
to.  A flow routes words from patterns to source quotas; each further copy of
a pattern's words costs more than the one before (a convex repetition cost),
so repeats are used only where quotas can't be met otherwise.  Within each
pattern documents are then selected in a seeded order until the words routed
from it are reached.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Overlapping membership patterns beyond this are refused, and patterns of any kind beyond the second: the driver solves
#: the flow of the former, and holds a row for each of the latter.
MOST_PATTERNS = 50_000
MOST_SOURCES = 2_000_000
#: Plans of up to so many patterns are sent to every task.
FEW = 20_000
BINS = 3  # hex digits of the seeded key in one histogram level: 4096 bins


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; what exceeds ``most`` times a source's size is reshared among the others."""
    target = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(total)
    while open_:
        scale = left / sum(weights[k] for k in open_)
        above = [k for k in open_ if weights[k] * scale > most * sizes[k]]
        if not above:
            for k in open_:
                target[k] = weights[k] * scale
            break
        for k in above:
            target[k] = float(most * sizes[k])
            left -= target[k]
        gone = set(above)
        open_ = [k for k in open_ if k not in gone]
    return target


def route(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], copies: int = 2) -> list[dict[int, int]]:
    """Words that each pattern ``(sources, words)`` sends to each source: a min-cost flow.

    A pattern can send its words ``copies`` times; the k-th copy of a word
    costs 2k - 1, so the total cost is the square of the repetition.
    Successive shortest paths with potentials; quotas that can't be filled stay
    short.
    """
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, k, v in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y), cap.append(k), cost.append(v)

    for p, (members, words) in enumerate(patterns):
        for k in range(1, copies + 1):
            arc(start, p, words, 2 * k - 1)
        for s in members:
            arc(p, n + s, copies * words, 0)
    for s, q in enumerate(quotas):
        arc(n + s, end, q, 0)
    height = [0] * (n + m + 2)
    while True:
        best = [-1] * len(height)
        via = [-1] * len(height)
        todo = [(0, start)]
        dist = {start: 0}
        while todo:
            d, v = heapq.heappop(todo)
            if best[v] >= 0:
                continue
            best[v] = d
            for e in out[v]:
                if cap[e] > 0 and best[to[e]] < 0:
                    w = d + cost[e] + height[v] - height[to[e]]
                    if w < dist.get(to[e], 1 << 62):
                        dist[to[e]] = w
                        via[to[e]] = e
                        heapq.heappush(todo, (w, to[e]))
        if best[end] < 0:
            break
        height = [h + (b if b >= 0 else best[end]) for h, b in zip(height, best)]
        # All shortest paths of this length at once: a blocking flow by depth-first search.
        at = [0] * len(height)
        while True:
            path: list[int] = []
            v, seen = start, {start}
            while v != end:
                while at[v] < len(out[v]):
                    e = out[v][at[v]]
                    if cap[e] > 0 and to[e] not in seen and cost[e] + height[v] - height[to[e]] == 0:
                        break
                    at[v] += 1
                if at[v] == len(out[v]):
                    if not path:
                        break
                    seen.discard(v)
                    v = to[path.pop() ^ 1]
                    at[v] += 1
                    continue
                path.append(e)
                v = to[e]
                seen.add(v)
            if v != end:
                break
            amount = min(cap[e] for e in path)
            for e in path:
                cap[e] -= amount
                cap[e ^ 1] += amount
    flow: list[dict[int, int]] = []
    for p in range(n):
        flow.append({to[e] - n: cap[e ^ 1] for e in out[p] if n <= to[e] < n + m and cost[e] == 0 and e % 2 == 0 and cap[e ^ 1]})
    return flow


def routed_words(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], copies: int = 2) -> list[int]:
    """Words taken of each pattern.  A source that one pattern alone belongs to, and to no other source, needs no flow: it gets all it can of its quota."""
    uses = [0] * len(quotas)
    for members, _ in patterns:
        for s in members:
            uses[s] += 1
    alone = [len(members) == 1 and uses[members[0]] == 1 for members, _ in patterns]
    rest = [p for p, a in zip(patterns, alone) if not a]
    if len(rest) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} overlapping membership patterns")
    known = sorted({s for members, _ in rest for s in members})
    spot = {s: k for k, s in enumerate(known)}
    flow = iter(route([([spot[s] for s in members], words) for members, words in rest], [quotas[s] for s in known], copies))
    return [min(copies * words, quotas[members[0]]) if a else sum(next(flow).values()) for (members, words), a in zip(patterns, alone)]


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= FEW else table


def _edges(spark, keyed: DataFrame, need: dict[str, int]) -> dict[str, tuple[str, int]]:
    """For each pattern the two-level bin of the key where the running size passes ``need``, and the size before it."""
    level = materialize(keyed.groupBy("pattern", F.substring("key", 1, BINS).alias("bin")).agg(F.sum("size").alias("s")), "bins")

    def passing(level: DataFrame, need: dict[str, int]) -> dict[str, tuple[str, int]]:
        wanted = spark.createDataFrame([(p, n) for p, n in need.items()], "pattern string, need long")
        run = level.withColumn("upto", F.sum("s").over(Window.partitionBy("pattern").orderBy("bin")))
        run = run.join(_small(wanted, len(need)), "pattern").where("upto > need and upto - s <= need")
        return {r["pattern"]: (r["bin"], r["before"]) for r in run.select("pattern", "bin", (F.col("upto") - F.col("s")).alias("before")).collect()}

    first = passing(level, need)
    if not first:
        return {}
    inside = _small(spark.createDataFrame([(p, b) for p, (b, _) in first.items()], "pattern string, bin string"), len(first))
    finer = keyed.withColumn("bin", F.substring("key", 1, BINS)).join(inside, ["pattern", "bin"]).groupBy("pattern", F.substring("key", 1, 2 * BINS).alias("bin")).agg(F.sum("size").alias("s"))
    second = passing(finer, {p: need[p] - before for p, (_, before) in first.items()})
    return {p: (b, first[p][1] + before) for p, (b, before) in second.items()}


def select(docs: DataFrame, routed: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds ``copies`` to ``docs(pattern, size, key)``; ``routed`` has (words of the pattern, words to take).

    Every document is taken as often as all of them can be, then once more in
    order of the seeded key while the words fit; what is left is filled by the
    one document whose size comes closest to it.  Documents without words are
    taken as often as all are.
    """
    spark = docs.sparkSession
    whole = {p: take // words if words else 0 for p, (words, take) in routed.items()}
    need = {p: take - whole[p] * words for p, (words, take) in routed.items()}
    part = {p: n for p, n in need.items() if n > 0}
    edge = _edges(spark, docs.where("size > 0"), part)
    plan = spark.createDataFrame([(p, int(whole[p]), int(need[p]), *(edge.get(p) or (None, None))) for p in routed], "pattern string, whole long, need long, edge string, before long")
    d = docs.join(_small(plan, len(routed)), "pattern")
    bin_ = F.substring("key", 1, 2 * BINS)
    below = d.where("size > 0 and need > 0").withColumn("bin", bin_)
    run = F.sum("size").over(Window.partitionBy("pattern").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    at_edge = below.where("bin = edge").withColumn("upto", F.col("before") + run)
    last = at_edge.where("upto <= need").groupBy("pattern").agg(F.max("key").alias("last"), F.max("upto").alias("reached"))
    filled = plan.select("pattern", "need", "before").where("need > 0 and before is not null").join(last, "pattern", "left")
    left = filled.select("pattern", F.col("last"), (F.col("need") - F.coalesce("reached", "before")).alias("left"))
    rest = below.join(_small(left, len(routed)), "pattern").where("left > 0 and (bin > edge or (bin = edge and (last is null or key > last)))")
    filler = rest.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "key", "size", "left")).alias("f"))
    filler = filler.where("f.size < 2 * f.left").select("pattern", F.col("f.key").alias("filler"))
    ends = left.join(filler, "pattern", "left").select("pattern", "last", "filler")
    d = d.join(_small(ends, len(routed)), "pattern", "left")
    more = (F.col("size") > 0) & (F.col("need") > 0) & ((bin_ < F.col("edge")) | ((bin_ == F.col("edge")) & (F.col("key") <= F.col("last"))) | (F.col("key") == F.col("filler")))
    return d.withColumn("copies", F.col("whole") + F.coalesce(more, F.lit(False)).cast("long"))


def mix(docs: DataFrame, sources: Column, share: float = 1.5, most: int = 2, weights: Sequence[float] = (5, 2, 1), seed: int = 9, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs(doc_id, text)`` whose ``sources`` (array of strings) may overlap.

    Sources in order of code points, null last, weigh ``weights`` in turn and
    share ``share`` times all words; a target stops at ``most`` times the words
    of its source, the excess goes to the others.  Returns the documents with
    doc_id, pattern, size, copies, taken and ``row``, a struct of the ``keep`` columns, and a table
    (source, source_size, target).  A document in no source (a null or empty
    array) is never taken.  A null text has no words.  Rows that repeat an id
    share one place in the order and are taken or left together, except that
    their sizes count one by one.  An empty table gives empty results.  Over
    MOST_PATTERNS patterns that share sources, or MOST_SOURCES in all, raise.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(c) for c in keep]).alias("row") if keep else F.lit(None).cast("string").alias("row")
    d = docs.select("doc_id", row, F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))).alias("sources"), word_count(F.col("text")).alias("size"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = materialize(d.select("*", F.to_json("sources").alias("pattern"), key.alias("key")), "sizes")
    found = d.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("words")).orderBy("pattern").limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} membership patterns")
    names = sorted({s for r in found for s in r["sources"]}, key=lambda s: (s is None, (s or "").encode("utf-8")))
    spot = {s: k for k, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r["sources"]:
            sizes[spot[s]] += r["words"]
    total = share * sum(r["words"] for r in found)
    target = capped_targets(sizes, [weights[k % len(weights)] for k in range(len(names))], total, most)
    taken = routed_words([([spot[s] for s in r["sources"]], r["words"]) for r in found], [round(t) for t in target], most)
    routed = {r["pattern"]: (r["words"], n) for r, n in zip(found, taken)}
    chosen = select(d, routed) if routed else d.withColumn("copies", F.lit(0).cast("long"))
    chosen = chosen.select("doc_id", *["row"] * bool(keep), "pattern", "size", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    table = spark.createDataFrame([(s, int(z), float(t)) for s, z, t in zip(names, sizes, target)], "source string, source_size long, target double")
    return chosen, table


#: The contract query in SQL; a source's scale is where its cap stops binding.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5('9|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
ordered AS (
  SELECT *, 2.0 * source_size / w AS r, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS n FROM weighted),
scaled AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM src) - coalesce(sum(2.0 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM ordered),
fixed AS (
  SELECT arg_min(scale, n) FILTER (WHERE r >= scale) AS scale FROM scaled),
targets AS (
  SELECT source, source_size, least(w * (SELECT scale FROM fixed), 2.0 * source_size) AS target FROM scaled),
need AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(round(t.target) AS BIGINT) // t.source_size ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
run AS (
  SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS need,
         sum(size) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM need),
lefts AS (
  SELECT *, need - coalesce(max(upto) FILTER (WHERE upto <= need) OVER (PARTITION BY source), 0) AS rest FROM run),
fills AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY (upto <= need OR size = 0), abs(size - rest), key) AS place FROM lefts)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       CAST(size * (whole + CASE WHEN size > 0 AND need > 0 AND (upto <= need OR (place = 1 AND rest > 0 AND size < 2 * rest)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM fills
"""
