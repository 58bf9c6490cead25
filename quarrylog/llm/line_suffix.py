"""Line dedup by a suffix array over line-ID sequences, in DataFrame operations only.

Every document is a sequence of line IDs.  Prefix doubling ranks the suffixes
by their first 1, 2, 4, ... lines: the rank at 2h of a suffix is the pair of
the ranks at h of itself and of the suffix h lines on.  Suffixes of equal rank
at h form an LCP interval of depth h.  The rank of an interval is its first
suffix in document order, so the ranks tell earlier from later copies without
a global sort; suffixes whose rank is unique drop out.  The later members of
the intervals start the later copies of the repeated line runs, and their
union is made of maximal stretches before any line is listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, materialize

#: A run of a single line counts from this many words, and a shorter line if it stands in two documents; runs of more lines always count.
MIN_WORDS = 10


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc, k, wide, id1, id2): the k-th line with a word of its text.

    ``doc`` orders documents by id and tells rows of one id and unlike texts
    apart; ``wide`` marks lines of MIN_WORDS words or more.
    """
    rows = docs.select("doc", F.posexplode(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))).alias("k", "line"))
    line = F.col("line")
    return rows.select("doc", "k", (F.regexp_count(line, F.lit(WORD)) >= MIN_WORDS).alias("wide"), F.xxhash64(line).alias("id1"), F.xxhash64(F.lit(4), line).alias("id2"))


def _rank(pairs: DataFrame, by: list[str], instead: list[DataFrame]) -> DataFrame:
    """Suffixes of equal ``by`` get their first member as ``rank``, and the last document as ``last``; suffixes alone in their interval go.

    ``pairs`` is a written table, as it is read twice; the tables in ``instead``
    go once the ranks are there.  Rows of repeated documents come in with their
    lines, and are one from then on.
    """
    intervals = pairs.groupBy(*by).agg(F.min(F.struct("doc", "k")).alias("rank"), F.max("doc").alias("last"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    # Written first: over an aggregation in its own stage Spark can't split the rows of a hot line among tasks.
    intervals = materialize(intervals, "intervals")
    ranked = pairs.join(intervals, by).drop(*by)
    return materialize(ranked.distinct() if "wide" in ranked.columns else ranked, "line-ranks", [intervals, *instead])


def repeated_runs(ids: DataFrame) -> DataFrame:
    """(doc, k, n): the n lines from the k-th on are a copy of earlier lines; for each start the longest that doubling meets.  ``ids`` is deleted."""
    later = F.col("rank") != F.struct("doc", "k")
    level, h = _rank(ids, ["id1", "id2"], [ids]), 1
    found = [level]
    runs = level.where(later & (F.col("wide") | (F.col("rank.doc") != F.col("last")))).select("doc", "k", F.lit(1).alias("n"))
    while not level.isEmpty():
        ranks = level.select("doc", "k", "rank")
        ahead = ranks.select("doc", (F.col("k") - h).alias("k"), F.col("rank").alias("next"))
        pairs = materialize(ranks.withColumnRenamed("rank", "this").join(ahead, ["doc", "k"]), "line-pairs")
        level = _rank(pairs, ["this", "next"], [pairs])
        found.append(level)
        h *= 2
        runs = runs.unionByName(level.where(later).select("doc", "k", F.lit(h).alias("n")))
    return materialize(runs.groupBy("doc", "k").agg(F.max("n").alias("n")), "runs", found)


def stretches(runs: DataFrame) -> DataFrame:
    """(doc, s, e): the lines from s up to e, e left out, that ``runs(doc, k, n)`` cover; no line twice, at most one row for each run."""
    order = Window.partitionBy("doc").orderBy("k")
    reach = F.max(F.col("k") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = runs.select("doc", F.col("k").alias("s"), F.least(reach, F.lead("k").over(order)).alias("e"))
    return ends.where("e > s")


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the later copies of repeated line runs deleted from ``text``; adds n_lines and n_removed.

    Documents come in order of doc_id (null first), lines in order within
    them.  A line run counts if it has two lines, or one that has MIN_WORDS
    words or stands in two documents: a short line that only its own document
    repeats (a refrain, a table's rule) stays.  Lines are compared by two
    64-bit hashes, and lines without a word belong to no run and stay.  All but
    the first copy of a run are deleted, also within one document.  n_lines
    counts lines with a word.  A text all of whose lines go becomes empty; a
    null text stays null.  Rows that repeat an id and a text are one document
    and keep the same lines.  Other columns are returned as they are; if one is
    called n_lines or n_removed, the result of that name gets an underscore
    behind it.  An empty table gives an empty result.
    """
    doc, gone, lines, worded = (free(c, docs.columns) for c in ("__doc", "__gone", "__lines", "__worded"))
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text", F.col("doc_id").cast("string")).alias("h"))
    keyed = docs.withColumn(doc, key)
    ids = materialize(line_ids(keyed.select(F.col(doc).alias("doc"), "text")), "lines")
    covered = stretches(repeated_runs(ids))
    listed = covered.groupBy("doc").agg(F.flatten(F.transform(F.collect_list(F.struct("s", "e")), lambda x: F.sequence(x["s"], x["e"] - 1))).alias(gone))
    # Its own columns one by one: each is used several times, and would be computed for each line if it stood within the other.
    joined = keyed.join(listed.withColumnRenamed("doc", doc), doc, "left").withColumn(lines, F.split("text", "\n", -1))
    joined = joined.withColumn(worded, F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull()))
    cut = F.transform(gone, lambda k: F.get(worded, k))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut), lambda i: F.get(lines, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(worded), F.lit(0)).cast("long")
    n_removed = F.coalesce(F.size(gone), F.lit(0)).cast("long")
    columns = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(n_lines).alias(free("n_lines", docs.columns)), F.when(F.col(gone).isNull(), 0).otherwise(n_removed).alias(free("n_removed", docs.columns)))


#: The same rule in SQL, over runs of one and two lines: every longer run is covered by runs of two.
ORACLE = r"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
seq AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM numbered WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM seq),
ranked AS (
  SELECT doc_id, i, k, (len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 10 OR min(doc_id) OVER (PARTITION BY line) <> max(doc_id) OVER (PARTITION BY line))
           AND row_number() OVER (PARTITION BY line ORDER BY doc_id, k) > 1 AS one,
         after IS NOT NULL AND row_number() OVER (PARTITION BY line, after ORDER BY doc_id, k) > 1 AS two
  FROM pairs),
marked AS (
  SELECT doc_id, i, one OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY k), false) AS gone FROM ranked),
counted AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM marked GROUP BY doc_id),
kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) AS text
  FROM numbered n LEFT JOIN marked m ON n.doc_id = m.doc_id AND n.i = m.i
  WHERE NOT coalesce(m.gone, false) GROUP BY n.doc_id)
SELECT s.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed,
       md5(coalesce(k.text, '')) AS kept_md5
FROM split s LEFT JOIN counted c ON s.doc_id = c.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
