"""The canonical table of log lines, on which every query is built."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entries
from ..functions.severity import Patterns, entry_level, level_ordinal, line_level
from ..functions.timestamps import Declared, declared_time, entry_time, iso_text, line_time, source_of
from ..sources.files import LogFile, array_entries, few, formats, numbered_lines


#: Columns that ``enrich`` makes the others from.
RAW = ("file", "file_ord", "line_number", "content", "format", "mtime")


@dataclass(frozen=True)
class LineOptions:
    patterns: Patterns = field(default_factory=Patterns)
    declared: Sequence[Declared] = ()
    year: int | None = None


def enrich(raw: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:
    """The canonical columns for ``raw(file, file_ord, line_number, content, format, mtime)``.

    ``format`` is plain or json; lines of JSON files that hold no object stay,
    with ``is_entry`` false.  Columns that a query doesn't use cost nothing.

    * severity, level: of the entry, or of the line by patterns
    * text: the message of an entry, else the content; instance: where it comes from
    * ts_line, ts_entry: by the two ways to find a timestamp; ts: that of the format
    * ts_text: the timestamp as the timeline shows and sorts it
    """
    c, ref = F.col("content"), F.col("mtime")
    year = F.lit(options.year) if options.year else None
    is_json = F.col("format") == "json"
    with_entry = raw.withColumn("v", F.when(is_json, entries.entry(c)))
    v = F.col("v")
    declared = lambda x: declared_time(options.declared, F.col("file"), x, ref)
    stamp = entries.timestamp_text(v)
    out = with_entry.withColumns({
        "is_entry": v.isNotNull(),
        "severity": F.when(is_json, entries.severity(v)).otherwise(line_level(c, options.patterns)),
        "message": F.when(is_json, entries.message(v)),
        "json_ts": F.when(is_json, stamp),
        "text": F.when(v.isNotNull(), entries.content(v)).otherwise(c),
        "instance": F.when(is_json, F.col("file")).otherwise(F.coalesce(source_of(c), F.col("file"))),
        "time_line": line_time(c, ref, year, declared(c)),
        "time_entry": F.when(is_json, entry_time(stamp, declared(stamp))),
    })
    level = F.when(is_json, entry_level(F.col("severity"))).otherwise(F.col("severity"))
    return out.withColumns({
        "level": level_ordinal(level),
        "ts_line": F.col("time_line")["at"],
        "ts_entry": F.col("time_entry")["at"],
        "ts": F.when(is_json, F.col("time_entry")["at"]).otherwise(F.col("time_line")["at"]),
        "ts_text": F.when(is_json, F.col("json_ts")).otherwise(iso_text(F.col("time_line"))),
    })


def log_lines(spark: SparkSession, files: Sequence[LogFile], options: LineOptions = LineOptions(), as_lines: bool = False) -> DataFrame:
    """Canonical lines of log files; ``as_lines`` takes JSON files as plain text too."""
    kinds = formats(spark, files)
    arrays = [] if as_lines else [f for f in files if kinds[f.name] == "json_array"]
    numbered = numbered_lines(spark, [f for f in files if f not in arrays])
    if arrays:
        numbered = numbered.unionByName(array_entries(spark, arrays))
    known = spark.createDataFrame(
        [(f.name, k, "plain" if as_lines or kinds[f.name] == "plain" else "json", f.modified) for k, f in enumerate(files)],
        "file string, file_ord int, format string, mtime timestamp",
    )
    # A row for each file: a table that Spark can size, and that keeps the plan small however many files there are.
    return enrich(numbered.join(few(known, len(files)), "file").select(*RAW), options)


def within(ts: Column, since: datetime | None, until: datetime | None) -> Column:
    """Both bounds included; a line without a timestamp passes."""
    inside = F.lit(True)
    if since is not None:
        inside = inside & (ts >= F.lit(since))
    if until is not None:
        inside = inside & (ts <= F.lit(until))
    return F.lit(True) if since is None and until is None else ts.isNull() | inside
