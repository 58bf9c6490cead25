"""Queries that filter lines: search, errors, tail, statistics, time range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entries
from ..functions.severity import Patterns, line_at_least, ordinal
from ..functions.text import any_case, human_span
from ..plans.lines import RAW, LineOptions, enrich, within
from .result import Result

PLACE = ("file_ord", "file", "line_number")
SHOWN = ("file", "line_number", "severity", "ts_text", "text")
#: Rows that enter the timestamp parse ratio.
RATIO_ROWS = 1000


def _as_row(wide: bool = False) -> list[Column]:
    """Result columns: entries show their message and stamps, plain lines their content."""
    return [F.col("file"), F.col("line_number"), F.coalesce("severity", F.lit("")).alias("severity"), F.coalesce("ts_text", F.lit("")).alias("ts_text"), (F.when(F.col("format") == "json", F.coalesce("message", F.lit(""))).otherwise(F.col("content"))).alias("text")]


def entries_only(lines: DataFrame) -> DataFrame:
    """Without lines of JSON files that hold no object."""
    return lines.where((F.col("format") != "json") | F.col("is_entry"))


def unparsed(ts: Column, bounded: bool) -> Column:
    """How many scanned rows have no timestamp, where a bound makes that matter."""
    return (F.count_if(ts.isNull()) if bounded else F.lit(None)).cast("long").alias("unparsed_ts")


def first_matches(matching: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` matches in file order."""
    return matching.orderBy("file_ord", "file", "line_number").limit(limit)


def search(lines: DataFrame, pattern: str, limit: int = 50, field: str | None = None, since: datetime | None = None, until: datetime | None = None) -> Result:
    """Lines that match ``pattern`` in any case, first ones first.

    Without a field the pattern and the timestamps are of the raw line, also in
    JSON files; with one they are of the entry, and plain lines are unaffected
    by it.  Facts: total, unparsed_ts (of scanned rows).
    """
    wanted = any_case(pattern)
    if field:
        is_json = F.col("format") == "json"
        lines = entries_only(lines)
        hit = F.when(is_json, F.coalesce(entries.scalar_text(F.col("v"), field).rlike(wanted), F.lit(False))).otherwise(F.col("content").rlike(wanted))
        ts = F.col("ts")
    else:
        hit, ts = F.col("content").rlike(wanted), F.col("ts_line")
    bounded = since is not None or until is not None
    matching = lines.where(within(ts, since, until) & hit)
    rows = first_matches(matching, limit)
    rows = rows.select(*(_as_row() if field else [F.col("file"), F.col("line_number"), F.col("content").alias("text")]))
    facts = lines.agg(F.count_if(within(ts, since, until) & hit).alias("total"), unparsed(ts, bounded))
    return Result(rows, facts)


def search_first(lines: DataFrame, pattern: str, limit: int, field: str) -> DataFrame:
    """The first ``limit`` + 1 entries of one file whose field matches, without reading on: one too many tells that there are more.

    The file's splits come in order, so Spark takes them from the first on and
    stops; nothing is sorted and no total is known.
    """
    hit = entries.scalar_text(F.col("v"), field).rlike(any_case(pattern))
    return entries_only(lines).where(F.coalesce(hit, F.lit(False))).limit(limit + 1).select(*_as_row())


def with_context(lines: DataFrame, hits: DataFrame, context: int) -> DataFrame:
    """``hits(file, line_number)`` with the ``context`` lines before and after each, as one text with its own marked out.

    ``hits`` has a limit, so it is sent to every scan of the lines; the lines
    themselves aren't shuffled but for those near a hit.
    """
    h = hits.select(F.col("file").alias("hit_file"), F.col("line_number").alias("hit_line"))
    near = lines.join(F.broadcast(h), (F.col("file") == F.col("hit_file")) & F.col("line_number").between(F.col("hit_line") - context, F.col("hit_line") + context))
    parts = F.array_sort(F.collect_list(F.when(F.col("line_number") != F.col("hit_line"), F.struct("line_number", "content"))))
    got = near.groupBy(F.col("hit_file").alias("file"), F.col("hit_line").alias("line_number")).agg(parts.alias("p"))
    return hits.join(got, ["file", "line_number"], "left").withColumn("context", F.array_join(F.transform("p", lambda x: x["content"]), "\n")).drop("p")


def error_hits(level: str, exclude: str | None, patterns: Patterns = Patterns()) -> Column:
    """At or above a level, and not excluded (case counts); unknown severities never match."""
    entry = F.coalesce(F.col("level") >= ordinal(level), F.lit(False))
    hit = F.when(F.col("format") == "json", entry).otherwise(F.coalesce(line_at_least(F.col("content"), level, patterns), F.lit(False)))
    if exclude:
        any_case(exclude)
        hit = hit & ~F.when(F.col("format") == "json", F.coalesce("message", F.lit(""))).otherwise(F.col("content")).rlike(exclude)
    return hit


def newest(matching: DataFrame, limit: int, per_file: bool = True) -> DataFrame:
    """The last ``limit`` rows of each file, or of all of them."""
    w = Window.partitionBy("file").orderBy(F.desc("line_number"))
    if not per_file:
        return matching.orderBy(F.desc("file_ord"), F.desc("line_number")).limit(limit)
    return matching.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def errors(lines: DataFrame, level: str = "warn", limit: int = 100, exclude: str | None = None, since: datetime | None = None, until: datetime | None = None, options: LineOptions = LineOptions()) -> Result:
    """The newest errors of each file in their order.  Facts by file: error_count, omitted, unparsed_ts.

    Severity, time and text are made of the lines that the limit leaves;
    ``options`` are those that ``lines`` were made with.
    """
    lines = entries_only(lines)
    hit = within(F.col("ts"), since, until) & error_hits(level, exclude, options.patterns)
    last = newest(lines.where(hit).select(*RAW), limit)
    rows = enrich(last, options).orderBy(*PLACE).select(*_as_row())
    bounded = since is not None or until is not None
    counted = lines.groupBy("file").agg(F.count_if(hit).alias("total"), unparsed(F.col("ts"), bounded))
    facts = counted.select("file", F.least("total", F.lit(limit)).cast("long").alias("error_count"), F.greatest(F.col("total") - limit, F.lit(0)).cast("long").alias("omitted"), "unparsed_ts")
    return Result(rows, facts)


def tail(lines: DataFrame, limit: int = 50, since: datetime | None = None) -> Result:
    """The last lines of each file, as they are.  Facts by file: total, unparsed_ts."""
    keep = within(F.col("ts_line"), since, None)
    rows = newest(lines.where(keep), limit).orderBy(*PLACE).select("file", "line_number", "content")
    facts = lines.groupBy("file").agg(F.count_if(keep).alias("total"), unparsed(F.col("ts_line"), since is not None))
    return Result(rows, facts)


def _ends(lines: DataFrame, most: int, options: LineOptions, last: bool = False) -> DataFrame:
    """The first or last ``most`` lines of each file; only they are enriched."""
    w = Window.partitionBy("file").orderBy(F.desc("line_number") if last else "line_number")
    return enrich(lines.select(*RAW).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n"), options)


def stats(lines: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """By file: line_count (of entries in JSON files), counts by highest level, and how many of the first rows have a timestamp.

    ``options`` are those that ``lines`` were made with.
    """
    lines = entries_only(lines)
    counts = lines.groupBy("file").agg(F.count("*").alias("line_count"), *(F.count_if(F.col("level") == ordinal(x)).alias(f"{x}_count") for x in ("error", "warn", "fatal")))
    ratio = _ends(lines, RATIO_ROWS, options).groupBy("file").agg(F.count("*").alias("ts_sample_size"), F.round(F.count_if(F.col("ts").isNotNull()) / F.count("*"), 3).alias("ts_parse_ratio"))
    return counts.join(ratio, "file")


def time_range(lines: DataFrame, ends: int = 10, options: LineOptions = LineOptions()) -> DataFrame:
    """By file: earliest and latest among the first and last ``ends`` distinct lines, the span, line_count and the parse ratio of the sample."""
    lines = entries_only(lines)
    sample = _ends(lines, ends, options).unionByName(_ends(lines, ends, options, last=True)).groupBy("file", "content").agg(F.min("ts").alias("ts"))
    got = sample.groupBy("file").agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count("*").alias("ts_sample_size"), F.round(F.count_if(F.col("ts").isNotNull()) / F.count("*"), 3).alias("ts_parse_ratio"))
    counts = lines.groupBy("file").agg(F.count("*").alias("line_count"))
    span = human_span((F.unix_micros("latest") - F.unix_micros("earliest")) / 1_000_000)
    return counts.join(got, "file").withColumn("span", span)
