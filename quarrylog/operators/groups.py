"""Roll-ups by message template, window against baseline, correlation and trace ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entries
from ..functions.leaves import any_leaf_contains
from ..functions.severity import ordinal
from ..functions.template import template
from ..functions.text import any_case, key_value, literal
from ..functions.timeargs import Around, DiffBounds
from .result import Result
from .scan import entries_only

#: Seconds of time whose anchors one task merges.
SPAN = 6 * 3600


def _place() -> Column:
    return F.struct("file_ord", "file", "line_number")


def rollup(matching: DataFrame, scanned: DataFrame, most: int | None = None, quoted: bool = False) -> Result:
    """Matches by template: count, instances, first and last time, first line.

    ``scanned`` is what the matches were sought in: the instances of its files'
    first lines and those of the matches are what ``instances_seen`` counts
    against.  Facts: sources_scanned, templates, matches.
    """
    matching, scanned = entries_only(matching), entries_only(scanned)
    # First by template and instance, so that no template's lines gather unaggregated.
    part = matching.groupBy(template(F.col("text"), quoted).alias("template"), "instance").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min(F.struct(_place().alias("p"), F.col("text").alias("text"))).alias("s"))
    leads = scanned.groupBy("file").agg(F.min_by("instance", "line_number").alias("instance")).select("instance")
    universe = leads.unionByName(part.select("instance")).distinct().agg(F.count("*").alias("sources_scanned"))
    groups = part.groupBy("template").agg(F.sum("n").alias("count"), F.count("*").alias("instances"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min("s").getField("text").alias("sample"))
    rows = groups.join(F.broadcast(universe), F.lit(True)).select("template", "count", F.concat("instances", F.lit("/"), "sources_scanned").alias("instances_seen"), "first_ts", "last_ts", "sample")
    rows = rows.orderBy(F.desc("count"), "template")
    facts = groups.agg(F.count("*").alias("templates"), F.coalesce(F.sum("count"), F.lit(0)).alias("matches")).join(universe, F.lit(True))
    return Result(rows.limit(most) if most else rows, facts)


@dataclass(frozen=True)
class Summary:
    """What a window has that its baseline hasn't, and the other way round."""

    new: DataFrame
    gone: DataFrame
    error_rate: DataFrame
    volume: DataFrame
    facts: DataFrame


def _rate(n: Column, minutes: float) -> Column:
    return F.round(n / F.lit(minutes), 2) if minutes > 0 else F.lit(0.0)


def summarize(lines: DataFrame, bounds: DiffBounds, most: int = 20) -> Summary:
    """Templates new in the window or gone since the baseline, error rates and lines by instance.

    Lines without a timestamp count in both ranges.  One aggregation by
    template and instance reads the lines; everything else is made from it.
    """
    ts, since, until, base = F.col("ts"), F.lit(bounds.since), F.lit(bounds.until), F.lit(bounds.baseline)
    lost = ts.isNull()
    in_w, in_b = lost | ts.between(since, until), lost | ((ts >= base) & (ts < since))
    error = F.coalesce(F.col("level") >= ordinal("error"), F.lit(False))
    kept = entries_only(lines).where(lost | ((ts >= base) & (ts <= until)))
    part = kept.groupBy(template(F.col("text")).alias("template"), "instance").agg(
        F.count_if(in_w).alias("w"), F.count_if(in_b).alias("b"), F.count_if(in_w & error).alias("we"), F.count_if(in_b & error).alias("be"), F.count_if(lost).alias("lost"),
        F.min(F.when(in_w, ts)).alias("first_ts"), F.max(F.when(in_b, ts)).alias("last_ts"),
        F.min(F.when(in_w, F.struct(_place().alias("p"), F.col("text").alias("text")))).alias("s"),
    )
    w_min, b_min = (bounds.until - bounds.since).total_seconds() / 60, (bounds.since - bounds.baseline).total_seconds() / 60
    seen = part.agg(F.count_distinct("instance").alias("sources_seen"), F.coalesce(F.sum("lost"), F.lit(0)).alias("unparsed_ts"))
    by_template = part.groupBy("template").agg(F.sum("w").alias("w"), F.sum("b").alias("b"), F.count_if(F.col("w") > 0).alias("instances"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min("s").getField("text").alias("sample"))
    new = by_template.where("w > 0 and b = 0").join(F.broadcast(seen), F.lit(True)).select("template", F.col("w").alias("count"), F.concat("instances", F.lit("/"), "sources_seen").alias("instances_seen"), "first_ts", "sample")
    gone = by_template.where("b > 0 and w = 0").select("template", F.col("b").alias("baseline_count"), "last_ts")
    total = part.agg(F.coalesce(F.sum("we"), F.lit(0)).alias("window_errors"), F.coalesce(F.sum("be"), F.lit(0)).alias("baseline_errors"))
    rates = total.withColumn("window_per_min", _rate(F.col("window_errors"), w_min)).withColumn("baseline_per_min", _rate(F.col("baseline_errors"), b_min))
    rates = rates.withColumn("delta_per_min", F.round(F.col("window_per_min") - F.col("baseline_per_min"), 2))
    volume = part.groupBy(F.col("instance").alias("source")).agg(F.sum("w").alias("window_lines"), F.sum("b").alias("baseline_lines"))
    volume = volume.withColumn("window_per_min", _rate(F.col("window_lines"), w_min)).withColumn("baseline_per_min", _rate(F.col("baseline_lines"), b_min))
    volume = volume.withColumn("delta_per_min", F.round(F.col("window_per_min") - F.col("baseline_per_min"), 2)).orderBy(F.desc(F.abs("delta_per_min")), "source")
    facts = seen.join(new.agg(F.count("*").alias("new_templates")), F.lit(True)).join(gone.agg(F.count("*").alias("gone_templates")), F.lit(True))
    return Summary(new.orderBy(F.desc("count"), "template").limit(most), gone.orderBy(F.desc("baseline_count"), "template").limit(most), rates, volume, facts)


def id_hits(value: str, field: str | None = None) -> Column:
    """Lines about an identifier: plain lines that contain it (after the field's name, if one is given), entries whose field equals it or any of whose text values contain it."""
    content, v = F.col("content"), F.col("v")
    if field:
        plain = content.rlike(literal(field) + r"[=:]\s*" + literal(value))
        entry = F.coalesce(entries.scalar_text(v, field) == value, F.lit(False))
    else:
        plain = content.contains(value)
        entry = any_leaf_contains(v, value) | F.coalesce(F.concat_ws("\x00", "severity", "message", "json_ts").contains(value), F.lit(False))
    return F.when(F.col("format") == "json", entry).otherwise(plain)


def correlate(lines: DataFrame, value: str, field: str | None = None, limit: int = 200) -> Result:
    """The timeline of an identifier: by timestamp text, lines without one last, then in file order.  Facts: total, unparsed_ts, files_matched."""
    hits = entries_only(lines).where(id_hits(value, field))
    rows = hits.orderBy(F.asc_nulls_last("ts_text"), "file_ord", "file", "line_number").limit(limit).select("file", "line_number", F.col("ts_text").alias("timestamp"), "severity", F.col("text").alias("content"))
    by_file = hits.groupBy("file_ord", "file").agg(F.count("*").alias("n"), F.count_if(F.col("ts_text").isNull()).alias("lost"))
    facts = by_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("lost"), F.lit(0)).alias("unparsed_ts"), F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "file"))), lambda x: x["file"]).alias("files_matched"))
    return Result(rows, facts)


def _islands(stretches: DataFrame, width: int, *by: str) -> DataFrame:
    """(by, k, a, z, anchor_count): stretches of time no more than ``width`` apart, merged and numbered."""
    w = Window.partitionBy(*by).orderBy("a")
    apart = F.col("a") - F.lag("z").over(w) > width
    island = stretches.withColumn("fresh", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("k", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "k").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("anchor_count").alias("anchor_count"))


def sections(anchors: DataFrame, around: Around) -> DataFrame:
    """(from_ts, to_ts, anchor_count): the windows around ``anchors.ts``, merged where they overlap or touch.

    Three levels: anchors in one bucket as wide as a window always share a
    section; islands are made of those within a SPAN of time, in parallel; and
    only a span's first and last island can touch another span's, so that two
    rows for each span are put in order at the end.
    """
    width = (around.before + around.after) * 1_000_000
    micros = F.unix_micros("ts")
    bucket = F.floor(micros / width) if width else micros
    at = anchors.where("ts is not null").groupBy(bucket.alias("bucket")).agg(F.min(micros).alias("a"), F.max(micros).alias("z"), F.count("*").alias("anchor_count"))
    here = _islands(at.withColumn("span", F.floor(F.col("a") / (SPAN * 1_000_000))), width, "span")
    here = here.withColumn("edge", (F.col("k") == 1) | (F.col("k") == F.max("k").over(Window.partitionBy("span")))).select("edge", "a", "z", "anchor_count")
    got = _islands(here.where("edge").drop("edge"), width).drop("k").unionByName(here.where("not edge").drop("edge"))
    return got.select(F.timestamp_micros(F.col("a") - around.before * 1_000_000).alias("from_ts"), F.timestamp_micros(F.col("z") + around.after * 1_000_000).alias("to_ts"), "anchor_count")


@dataclass(frozen=True)
class AnchorResult:
    sections: DataFrame
    entries: DataFrame
    facts: DataFrame


def anchor(lines: DataFrame, pattern: str, around: Around = Around(), most_sections: int = 5, limit: int = 200) -> AnchorResult:
    """Everything near the lines that match ``pattern``: the earliest sections, and their entries in order.

    The second pass joins the lines with at most ``most_sections`` intervals,
    which are sent to every task.  Facts: total_anchors, anchors_unparsed_ts.
    """
    lines = entries_only(lines)
    hits = lines.where(F.col("text").rlike(any_case(pattern)))
    all_sections = sections(hits.select("ts"), around)
    kept = all_sections.orderBy("from_ts").limit(most_sections)
    near = lines.where("ts is not null").join(F.broadcast(kept), F.col("ts").between(F.col("from_ts"), F.col("to_ts")))
    order = ["from_ts", F.asc_nulls_last("ts_text"), "file", "line_number"]
    rows = near.orderBy(*order).limit(limit).select("from_ts", "to_ts", "file", "line_number", F.col("ts_text").alias("timestamp"), "severity", F.col("text").alias("content"))
    facts = hits.agg(F.count("*").alias("total_anchors"), F.count_if(F.col("ts").isNull()).alias("anchors_unparsed_ts"))
    facts = facts.join(all_sections.agg(F.count("*").alias("total_sections")), F.lit(True)).join(near.agg(F.count("*").alias("total_entries"), F.array_sort(F.collect_set("file")).alias("files_matched")), F.lit(True))
    return AnchorResult(kept.orderBy("from_ts"), rows, facts)


def trace_ids(lines: DataFrame, field: str, most: int = 50) -> Result:
    """Values of a field or key with their count and first and last timestamp text.  Facts: distinct_values."""
    value = F.when(F.col("format") == "json", entries.scalar_text(F.col("v"), field)).otherwise(key_value(F.col("content"), field))
    counted = lines.select(value.alias("value"), "ts_text").where("value is not null").groupBy("value").agg(F.count("*").alias("count"), F.min("ts_text").alias("first_seen"), F.max("ts_text").alias("last_seen"))
    return Result(counted.orderBy(F.desc("count"), "value").limit(most), counted.agg(F.count("*").alias("distinct_values")))


