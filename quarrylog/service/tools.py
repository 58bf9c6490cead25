"""The tools: arguments in, structured result and text out.

Results are small by construction (every list has a limit, and what a limit
left out is reported under ``omissions``), so they are collected here and
nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import Patterns
from ..functions.timeargs import around, diff_bounds, instant, now_utc
from ..functions.timestamps import Declared
from ..operators import fields as field_ops
from ..operators import groups, scan
from ..operators.result import Omissions
from ..plans.line_store import LineStore
from ..plans.lines import LineOptions, log_lines, within
from ..session import configure
from ..sources.cloud import sync
from ..sources.files import MAX_FILE_MB, list_files, listing, readable, resolve
from ..streaming.cursor import poll
from .toon import parts, respond, to_json


def iso(value: object) -> object:
    return value.strftime("%Y-%m-%dT%H:%M:%S") + (f".{value.microsecond:06d}" if value.microsecond else "") + "Z" if isinstance(value, datetime) else value


def rows_of(df: DataFrame) -> list[dict]:
    return [{k: iso(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


def fact(df: DataFrame) -> dict:
    return (rows_of(df) or [{}])[0]


@dataclass
class Tools:
    """All tools over one log directory."""

    spark: SparkSession
    log_dir: str
    patterns: Patterns = field(default_factory=Patterns)
    declared: list[Declared] = field(default_factory=list)
    max_mb: int = MAX_FILE_MB
    status: dict[str, dict] = field(default_factory=dict)
    now: datetime | None = None
    store: LineStore | None = None

    def __post_init__(self) -> None:
        configure(self.spark)
        if self.store:
            self.store.options = self._options()

    def _now(self) -> datetime:
        return self.now or now_utc()

    def _options(self) -> LineOptions:
        return LineOptions(self.patterns, tuple(self.declared), self._now().year)

    def _files(self, file: str | None, om: Omissions):
        files, skipped = readable(self.spark, self.log_dir, file or None, self.max_mb)
        om.skipped(skipped)
        return files

    def _lines(self, file: str | None, om: Omissions, as_lines: bool = False, bounds: tuple[datetime | None, datetime | None] = (None, None)) -> DataFrame:
        """Lines of the files, or with time bounds and a store those that may lie within."""
        files = self._files(file, om)
        if self.store and files and any(bounds):
            return self.store.lines(files, *bounds, as_lines)
        return log_lines(self.spark, files, self._options(), as_lines)

    def _any_size(self, file: str | None = None) -> DataFrame:
        files = [resolve(self.spark, self.log_dir, file)] if file else list_files(self.spark, self.log_dir)
        return log_lines(self.spark, files, self._options())

    def _bounds(self, since: str | None, until: str | None) -> tuple[datetime | None, datetime | None]:
        return instant(since, self._now()), instant(until, self._now())

    def list_logs(self) -> tuple[dict, str]:
        rows = rows_of(listing(self.spark, self.log_dir, self.max_mb, self.status))
        data = {"entries": [{k: v for k, v in r.items() if v is not None or k == "warning"} for r in rows]}
        return data, respond(data)

    def log_stats(self, file: str) -> tuple[dict, str]:
        f = resolve(self.spark, self.log_dir, file)
        lines = self._any_size(file)
        data = {"file": file, "path": f.path, "size_bytes": f.size, "line_count": 0, "error_count": 0, "warn_count": 0, "fatal_count": 0, "ts_sample_size": 0, "ts_parse_ratio": None}
        data |= fact(scan.stats(lines, self._options()))
        data |= {"size_human": fact(listing(self.spark, self.log_dir).where(F.col("name") == file).select("size_human"))["size_human"], "modified": iso(f.modified)}
        return data, to_json(data)

    def time_range(self, file: str) -> tuple[dict, str]:
        data = {"file": file, "line_count": 0, "earliest": None, "latest": None, "span": None, "ts_sample_size": 0, "ts_parse_ratio": None}
        data |= fact(scan.time_range(self._any_size(file), options=self._options()))
        return data, to_json(data)

    def tail_log(self, file: str, lines: int = 50, since: str | None = None, cursor: str | None = None, format: str | None = None) -> tuple[dict, str]:
        om = Omissions()
        f = self._files(file, om)[0]
        start = instant(since, self._now())
        got = poll(self.spark, file, f.path, cursor)
        frame = self._lines(file, om, as_lines=True, bounds=(start, None))
        if cursor and not got.reset:
            frame = frame.where(F.col("line_number") >= got.first)
        result = scan.tail(frame, lines, start)
        facts = fact(result.facts)
        shown = rows_of(result.rows)
        om.cap("lines", facts.get("total", 0), lines, f"newest {lines}")
        data = {"file": file, "lines": len(shown), "content": "\n".join(r["content"] for r in shown), "cursor": got.cursor}
        if since:
            data["unparsed_ts"] = facts.get("unparsed_ts", 0)
        if got.reset:
            data["cursor_reset"] = True
        data = om.attach(data)
        notes = [f"# {k}: {to_json(data[k]) if isinstance(data[k], (dict, bool)) else data[k]}" for k in ("unparsed_ts", "cursor_reset", "omissions", "cursor") if k in data]
        text = to_json(data) if format == "json" else "\n".join([f"# tail {file} (last {len(shown)} lines)", *notes, data["content"]])
        return data, text

    def search_logs(self, pattern: str, file: str | None = None, max_results: int = 50, context: int = 0, field: str | None = None, rollup: bool = False, since: str | None = None, until: str | None = None, cursor: str | None = None, format: str | None = None) -> tuple[dict, str]:
        om = Omissions()
        lo, hi = self._bounds(since, until)
        if cursor and (field or rollup):
            raise ValueError("a cursor goes with neither field nor rollup")
        if rollup:
            lines = self._lines(file, om)
            wanted = lines.where(within(lines["ts"], lo, hi) & lines["text"].rlike(f"(?i){pattern}"))
            return self._rollup(wanted, lines, max_results, om, bool(since or until), format)
        if not file:
            raise ValueError("file is required without rollup")
        lines = self._lines(file, om, as_lines=field is None, bounds=(lo, hi))
        extra = {}
        if cursor is not None:
            got = poll(self.spark, file, self._files(file, om)[0].path, cursor or None)
            extra = {"cursor": got.cursor} | ({"cursor_reset": True} if got.reset else {})
            if cursor and not got.reset:
                lines = lines.where(F.col("line_number") >= got.first)
        if field and lo is None and hi is None:  # no total is asked for: stop at the first match too many
            shown = rows_of(scan.search_first(lines, pattern, max_results, field).drop("file"))
            if len(shown) > max_results:
                om.capped_at("matches", max_results)
            data = om.attach({"file": file, "matches": shown[:max_results], "returned": min(len(shown), max_results)})
            return data, respond(data, format)
        result = scan.search(lines, pattern, max_results, field, lo, hi)
        # Lines around a match may lie outside the bounds.
        shown = scan.with_context(self._lines(file, Omissions(), as_lines=True), result.rows, context) if context and not field else result.rows
        facts = fact(result.facts)
        om.cap("matches", facts["total"], max_results, f"first {max_results}")
        data = {"file": file, "matches": sorted(rows_of(shown.drop("file")), key=lambda r: r["line_number"]), "returned": min(facts["total"], max_results)} | extra
        if facts.get("unparsed_ts") is not None:
            data["unparsed_ts"] = facts["unparsed_ts"]
        data = om.attach(data)
        return data, respond(data, format)

    def _rollup(self, matching: DataFrame, lines: DataFrame, most: int | None, om: Omissions, bounded: bool, format: str | None) -> tuple[dict, str]:
        got = groups.rollup(matching, lines, most)
        facts = fact(got.facts)
        if most:
            om.cap("templates", facts["templates"], most, f"top {most} by count")
        data = {"entries": rows_of(got.rows), "sources_scanned": facts["sources_scanned"], "total_matches": facts["matches"]}
        if bounded:
            data["unparsed_ts"] = scan.entries_only(lines).where("ts is null").count()
        data = om.attach(data)
        return data, respond(data, format)

    def get_errors(self, file: str, lines: int = 100, level: str = "warn", exclude: str | None = None, since: str | None = None, until: str | None = None, format: str | None = None) -> tuple[dict, str]:
        om = Omissions()
        lo, hi = self._bounds(since, until)
        got = scan.errors(self._lines(file, om, bounds=(lo, hi)), level, lines, exclude, lo, hi, self._options())
        facts = fact(got.facts)
        om.omitted("lines", facts.get("omitted", 0), f"newest {lines}")
        data = {"file": file, "error_count": facts.get("error_count", 0), "matches": rows_of(got.rows.drop("file"))}
        if lo or hi:
            data["unparsed_ts"] = facts.get("unparsed_ts", 0)
        data = om.attach(data)
        return data, respond(data, format)

    def all_errors(self, lines: int = 20, level: str = "warn", exclude: str | None = None, rollup: bool = False, since: str | None = None, until: str | None = None, format: str | None = None) -> tuple[dict, str]:
        om = Omissions()
        lo, hi = self._bounds(since, until)
        if rollup:
            scanned = self._lines(None, om)
            return self._rollup(scanned.where(within(scanned["ts"], lo, hi) & scan.error_hits(level, exclude, self.patterns)), scanned, None, om, bool(lo or hi), format)
        scanned = self._lines(None, om, bounds=(lo, hi))
        got = scan.errors(scanned, level, lines, exclude, lo, hi, self._options())
        facts, rows = rows_of(got.facts), rows_of(got.rows)
        om.omitted("lines", sum(f["omitted"] for f in facts), f"newest {lines} of each file")
        files = [{"file": f["file"], "error_count": f["error_count"], "matches": [{k: v for k, v in r.items() if k != "file"} for r in rows if r["file"] == f["file"]]} for f in sorted(facts, key=lambda f: f["file"]) if f["error_count"]]
        data = {"files": files}
        if lo or hi:
            data["unparsed_ts"] = sum(f["unparsed_ts"] or 0 for f in facts)
        data = om.attach(data)
        text = "\n\n".join(f"--- {f['file']} ({f['error_count']} errors) ---\n" + respond({"matches": f["matches"]}) for f in files) or "No errors found in any log file."
        return data, to_json(data) if format == "json" else text

    def aggregate(self, field: str, op: str, file: str | None = None, pattern: str | None = None, max_values: int = 50, since: str | None = None, until: str | None = None, format: str | None = None) -> tuple[dict, str]:
        om = Omissions()
        lo, hi = self._bounds(since, until)
        lines = self._lines(file, om, bounds=(lo, hi))
        data: dict = {"field": field, "op": op}
        plain = not (pattern or lo or hi) and self.store is not None and op in ("exists", "count")
        proven = self.store.totals_without(self._files(file, Omissions()), field) if plain else None
        if proven:  # no line has the field: nothing is read
            none = {"lines_without": proven["entries"], "non_json": proven["others"]}
            data |= {"exists": False, "lines_with": 0} | none | {"sample": None} if op == "exists" else {"occurrences": 0} | none
        elif op == "exists":
            got = fact(field_ops.exists(lines, field, pattern, lo, hi))
            data |= {"exists": got["lines_with"] > 0} | {k: got[k] for k in ("lines_with", "lines_without", "non_json", "sample")}
        elif op == "count":
            data |= fact(field_ops.count(lines, field, pattern, lo, hi))
        elif op == "values":
            got = field_ops.values(lines, field, max_values, pattern, lo, hi)
            facts = fact(got.facts)
            om.cap("values", facts["distinct_values"], max_values, f"top {max_values} by count")
            data |= {"distinct_values": facts["distinct_values"], "occurrences": facts["occurrences"], "entries": rows_of(got.rows)}
        else:
            raise ValueError(f"unknown op {op!r}: exists, values or count")
        if lo or hi:
            data["unparsed_ts"] = lines.where("ts is null").count()
        data = om.attach(data)
        return data, respond(data, format)

    def summarize(self, window: str | None = None, since: str | None = None, until: str | None = None, baseline: str | None = None, file: str | None = None, max_templates: int = 20, format: str | None = None) -> tuple[dict, str]:
        om = Omissions()
        b = diff_bounds(window, since, until, baseline, self._now())
        files = self._files(file, om)
        lines = self.store.lines(files, b.baseline, b.until) if self.store and files else log_lines(self.spark, files, self._options())
        got = groups.summarize(lines, b, max_templates)
        facts = fact(got.facts)
        om.cap("new_templates", facts["new_templates"], max_templates, f"top {max_templates} by count")
        om.cap("gone_templates", facts["gone_templates"], max_templates, f"top {max_templates} by baseline count")
        meta = {"window": {"since": iso(b.since), "until": iso(b.until)}, "baseline": {"since": iso(b.baseline), "until": iso(b.since)}, "files_scanned": len(files), "sources_seen": facts["sources_seen"], "error_rate": fact(got.error_rate), "unparsed_ts": facts["unparsed_ts"]}
        lists = {"new_templates": rows_of(got.new), "gone_templates": rows_of(got.gone), "volume": rows_of(got.volume)}
        data = om.attach(meta | lists)
        titles = {"new_templates": "new templates", "gone_templates": "gone templates", "volume": "volume by source"}
        text = to_json(data) if format == "json" else parts({k: v for k, v in data.items() if k not in lists}, [(f"{titles[k]} ({len(v)})", v) for k, v in lists.items()])
        return data, text

    def correlate(self, value: str | None = None, field: str | None = None, anchor: dict | None = None, max_results: int = 200, max_sections: int = 5, format: str | None = None) -> tuple[dict, str]:
        om = Omissions()
        if bool(value) == bool(anchor):
            raise ValueError("either value or anchor is required")
        lines = self._any_size()
        if value:
            got = groups.correlate(lines, value, field, max_results)
            facts = fact(got.facts)
            om.cap("matches", facts["total"], max_results, f"first {max_results} by time")
            data = om.attach({"value": value, "total_matches": facts["total"], "files_matched": facts["files_matched"] or [], "unparsed_ts": facts["unparsed_ts"], "timeline": rows_of(got.rows)})
            rest = {k: v for k, v in data.items() if k != "timeline"}
            return data, to_json(data) if format == "json" else f"# {to_json(rest)}\n" + respond({"matches": data["timeline"]})
        near = around(anchor.get("window") if anchor.get("window") is not None else {k: anchor[k] for k in ("before", "after") if k in anchor} or None)
        got = groups.anchor(lines, anchor["pattern"], near, max_sections, max_results)
        facts, rows = fact(got.facts), rows_of(got.entries)
        om.cap("sections", facts["total_sections"], max_sections, f"first {max_sections} by time").cap("entries", facts["total_entries"], max_results, f"first {max_results} by time")
        made = [{"from": s["from_ts"], "to": s["to_ts"], "anchor_count": s["anchor_count"], "entries": [{k: v for k, v in r.items() if k not in ("from_ts", "to_ts")} for r in rows if r["from_ts"] == s["from_ts"]]} for s in rows_of(got.sections)]
        meta = {"anchor": anchor["pattern"], "window": near.label, "total_anchors": facts["total_anchors"], "anchors_unparsed_ts": facts["anchors_unparsed_ts"], "total_entries": len(rows), "files_matched": facts["files_matched"]}
        data = om.attach(meta | {"sections": made})
        titled = [(f"window {s['from']} .. {s['to']} ({s['anchor_count']} anchor{'s' * (s['anchor_count'] != 1)})", s["entries"]) for s in made]
        return data, to_json(data) if format == "json" else parts({k: v for k, v in data.items() if k != "sections"}, titled, "(no anchor windows)")

    def trace_ids(self, field: str, file: str | None = None, max_values: int = 50) -> tuple[dict, str]:
        om = Omissions()
        got = groups.trace_ids(self._any_size(file), field, max_values)
        om.cap("values", fact(got.facts)["distinct_values"], max_values, f"top {max_values} by count")
        data = om.attach({"field": field, "entries": rows_of(got.rows)})
        return data, respond(data)

    def sync_logs(self, source: str, prefix: str = "", since: str | None = None) -> tuple[dict, str]:
        data = {"source": source} | sync(self.spark, source, self.log_dir, prefix, instant(since, self._now()))
        return data, to_json(data)

    NAMES = ("list_logs", "log_stats", "time_range", "tail_log", "search_logs", "get_errors", "all_errors", "aggregate", "summarize", "correlate", "trace_ids", "sync_logs")

    def call(self, name: str, arguments: dict | None = None) -> str:
        """A tool's text; ValueError for unknown names and arguments."""
        if name not in self.NAMES:
            raise ValueError(f"unknown tool {name!r}")
        tool: Callable = getattr(self, name)
        known = tool.__func__.__code__.co_varnames[1 : tool.__func__.__code__.co_argcount]
        if unknown := set(arguments or {}) - set(known):
            raise ValueError(f"unknown arguments of {name}: {', '.join(sorted(unknown))}")
        return tool(**(arguments or {}))[1]
