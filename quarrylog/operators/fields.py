"""Fields of JSON entries: presence, counts, values, paths."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entries
from ..functions.text import any_case
from ..plans.lines import within
from .result import Result
from .scan import unparsed

#: Bounds of the path survey of a file.
DEPTH = 6
MOST_PATHS = 500


def scanned(lines: DataFrame, pattern: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Lines in the time bounds that match the pattern in any case."""
    kept = lines.where(within(F.col("ts"), since, until))
    return kept.where(F.col("content").rlike(any_case(pattern))) if pattern else kept


def exists(lines: DataFrame, field: str, pattern: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """One row: lines with and without the field, lines that are no entries, and the first line that has it, with its place."""
    got = entries.value(F.col("v"), field)
    rows = scanned(lines, pattern, since, until)
    return rows.agg(
        F.count_if(got.isNotNull()).alias("lines_with"), F.count_if(F.col("is_entry") & got.isNull()).alias("lines_without"), F.count_if(~F.col("is_entry")).alias("non_json"),
        F.min(F.when(got.isNotNull(), F.struct("file_ord", "file", "line_number", "content"))).alias("__s"),
    ).select("lines_with", "lines_without", "non_json", F.col("__s.content").alias("sample"), F.col("__s.file").alias("sample_file"), F.col("__s.line_number").alias("sample_line"))


def count(lines: DataFrame, field: str, pattern: str | None = None, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    return exists(lines, field, pattern, since, until).select(F.col("lines_with").alias("occurrences"), "lines_without", "non_json")


def values(lines: DataFrame, field: str, most: int = 50, pattern: str | None = None, since: datetime | None = None, until: datetime | None = None) -> Result:
    """Values by count, then by value.  Facts: distinct_values, occurrences, unparsed_ts."""
    got = entries.as_text(entries.value(F.col("v"), field))
    counted = scanned(lines, pattern, since, until).select(got.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count"))
    rows = counted.orderBy(F.desc("count"), "value").limit(most)
    facts = counted.agg(F.count("*").alias("distinct_values"), F.coalesce(F.sum("count"), F.lit(0)).alias("occurrences"))
    return Result(rows, facts.join(lines.agg(unparsed(F.col("ts"), since is not None or until is not None)), F.lit(True)))


def paths(lines: DataFrame) -> DataFrame:
    """(file, path, opaque, lines): dotted paths of the objects in each file, down to DEPTH; lists and the deepest objects are opaque.

    Each level is aggregated before the next is unfolded from its objects.
    """
    spark: SparkSession = lines.sparkSession
    here = lines.where("is_entry").select("file", F.lit("").alias("path"), "v")
    found = None
    for depth in range(1, DEPTH + 1):
        out = here.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", F.concat("path", F.when(F.col("path") == "", "").otherwise("."), F.col("key")).alias("path"), F.col("value").alias("v"))
        kind = F.schema_of_variant("v")
        opaque = kind.startswith("ARRAY") | (kind.startswith("OBJECT") if depth == DEPTH else F.lit(False))
        level = out.groupBy("file", "path").agg(F.max(opaque).alias("opaque"), F.count("*").alias("lines"))
        found = level if found is None else found.unionByName(level)
        here = out.where(kind.startswith("OBJECT"))
    return found.groupBy("file", "path").agg(F.max("opaque").alias("opaque"), F.sum("lines").alias("lines"))


def absent(known: set[str], opaque: set[str], field: str) -> bool:
    """Whether a survey of all paths proves that no line has the field; a capped survey proves nothing."""
    if len(known) > MOST_PATHS:
        return False
    parts = field.split(".")
    above = {".".join(parts[:k]) for k in range(1, len(parts))}
    return field not in known and not above & opaque
