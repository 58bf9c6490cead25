"""Timestamps in log lines, as Catalyst expressions.

Every reader of a format returns a struct (at TIMESTAMP, digits INT) or null:
the instant, and how many fraction digits the source wrote, so that it can be
rendered as written.  A format's first match decides; if that is no valid
time the next format is tried.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations, and patterns of the timestamp formats that are recognised.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ANSI = "\x1b\\[[0-9;]*m"
SOURCE_TAG = r"^\[src:([A-Za-z0-9][A-Za-z0-9_-]*)\] "
ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
CLF = r"(\d{2})/([A-Z][a-z]{2})/(\d{4}):(\d{2}:\d{2}:\d{2})\s+([+-]\d{4})"
DATE_TIME = r"(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
SYSLOG = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})"
CLOCK = r"(\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)(?:\s?([AP]M))?"
ZONED_ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:[Zz]|[+-]\d{2}(?::?\d{2})?)$"
RFC3339 = r"(\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:?\d{2})?)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


def strip_source(c: Column) -> Column:
    return F.regexp_replace(c, SOURCE_TAG, "")


def source_of(c: Column) -> Column:
    """The name in a line's source tag, or null."""
    return F.nullif(F.regexp_extract(c, SOURCE_TAG, 1), F.lit(""))


def tag_line(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"[src:{name}] "), c)


def _pick(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def _micros(c: Column) -> Column:
    return F.unix_micros(c)


def _moved(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(_micros(at) - seconds.cast("long") * 1_000_000)


def _digits(text: Column) -> Column:
    return F.least(F.length(_pick(text, r"\.(\d+)", 1)), F.lit(6))


def _found(at: Column, digits: Column | None = None) -> Column:
    return let(at, lambda t: F.when(t.isNotNull(), F.struct(t.alias("at"), (F.lit(0) if digits is None else digits).cast("int").alias("digits"))))


def _iso(text: Column) -> Column:
    return let(text, _read_iso)


def _read_iso(text: Column) -> Column:
    """ISO text, UTC without a zone; offsets may lack their colon."""
    zoned = F.when(text.rlike(r"(?:[Zz]|[+-]\d{2}(?::?\d{2})?)$") & text.rlike(r":\d{2}(?:[.,]\d+)?(?:[Zz]|[+-])"), text).otherwise(F.concat(text, F.lit("Z")))
    plain = F.regexp_replace(F.regexp_replace(F.translate(zoned, "tz,", "TZ."), r"([+-]\d{2}):?(\d{2})$", "$1:$2"), r"(:\d{2}(?:\.\d+)?)([+-]\d{2})$", "$1$2:00")
    return _found(F.when(text != "", F.try_to_timestamp(plain)), _digits(F.translate(text, ",", ".")))


def _month(name: Column) -> Column:
    at = F.lit(None).cast("int")
    for k, m in reversed(list(enumerate(MONTHS, 1))):
        at = F.when(F.lower(name) == m.lower(), k).otherwise(at)
    return at


def _fields(c: Column, pattern: str, body: Callable[[Callable[[int], Column]], Column]) -> Column:
    """``body`` of the groups of a pattern's first match, the expensive search for which is made once."""
    return let(F.regexp_extract(c, pattern, 0), lambda m: F.when(m != "", body(lambda k: F.regexp_extract(m, pattern, k))))


def _clf(c: Column) -> Column:
    return _fields(c, CLF, lambda g: _read_clf(*(g(k) for k in range(1, 6))))


def _read_clf(day: Column, month: Column, year: Column, clock: Column, zone: Column) -> Column:
    number = F.when(month.rlike("^[A-Z][a-z]{2}$"), _month(month))
    at = F.try_to_timestamp(F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit("-"), day, F.lit("T"), clock, F.lit("Z")))
    size = F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60
    return _found(_moved(at, F.when(F.substring(zone, 1, 1) == "-", -size).otherwise(size)))


def _date_time(c: Column) -> Column:
    return _fields(c, DATE_TIME, lambda g: _iso(F.concat(g(1), F.lit("T"), g(2), F.lit("Z"))))


def _syslog(c: Column, year: Column) -> Column:
    def read(g: Callable[[int], Column]) -> Column:
        day = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(_month(g(1)).cast("string"), 2, "0"), F.lit("-"), F.lpad(g(2), 2, "0"))
        return _found(F.try_to_timestamp(F.concat(day, F.lit("T"), g(3), F.lit("Z"))))

    return _fields(c, SYSLOG, read)


def on_day_of(seconds: Column, micros: Column, reference: Column) -> Column:
    """A time of day on the reference's day, or the day before if that would be after the reference."""
    day = 86_400_000_000
    at = F.floor(_micros(reference) / day).cast("long") * day + seconds.cast("long") * 1_000_000 + micros.cast("long")
    return let(at, lambda t: F.timestamp_micros(t - F.when(t > _micros(reference), day).otherwise(0)))


def _clock(c: Column, before: str, after: str, reference: Column) -> Column:
    def read(g: Callable[[int], Column]) -> Column:
        half = g(2)
        parts = F.split(F.regexp_extract(g(1), r"^[\d:]+", 0), ":")
        part = F.transform(parts, lambda x: x.try_cast("int"))
        micros = F.coalesce(F.rpad(F.substring(_pick(g(1), r"\.(\d+)", 1), 1, 6), 6, "0").try_cast("long"), F.lit(0))

        def at(p: Column) -> Column:
            h, m, s = (F.get(p, F.lit(k)) for k in range(3))
            hour = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "PM", 12).otherwise(0))
            return F.when(hour.between(0, 23) & m.between(0, 59) & s.between(0, 59), _found(on_day_of(hour * 3600 + m * 60 + s, micros, reference), _digits(g(1))))

        return let(part, at)

    return _fields(c, before + CLOCK + after, read)


def line_time(c: Column, reference: Column, year: Column | None = None, declared: Column | None = None) -> Column:
    """(at, digits) of a plain line; ``declared`` goes first, then the recognised formats.

    ``reference`` (the file's modification time) gives time-only formats their
    day, ``year`` gives syslog dates theirs; by default the reference's.
    """
    year = F.year(reference) if year is None else year
    auto = let(strip_source(strip_ansi(c)), lambda x: _recognised(x, reference, year))
    return auto if declared is None else F.coalesce(declared, auto)


def _recognised(c: Column, reference: Column, year: Column) -> Column:
    ways = [
        _iso(_pick(c, rf"\[({ISO})\]", 1)), _iso(_pick(c, f"({ISO})", 1)), _clf(c), _date_time(c), _syslog(c, year),
        _clock(c, r"\[", r"\]", reference), _clock(c, r"^\[[^\]]+\]\s+", r"(?![\d.])", reference), _clock(c, "^", r"(?![\d.])", reference),
    ]
    return F.coalesce(*ways)


def entry_time(text: Column, declared: Column | None = None) -> Column:
    """(at, digits) of a JSON entry's timestamp text; without a declared format it must name its zone."""
    strict = let(text, lambda x: F.when(x.rlike(ZONED_ISO), _read_iso(x)))
    return strict if declared is None else F.coalesce(declared, strict)


def epoch_millis_text(c: Column) -> Column:
    """Epoch milliseconds as ISO text with three fraction digits."""
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_text(time: Column) -> Column:
    """ISO text of (at, digits), with the source's number of fraction digits."""
    shown = F.when(time["digits"] > 0, time["digits"] + 20).otherwise(19)
    return F.concat(F.substring(F.date_format(time["at"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(1), shown), F.lit("Z"))


@dataclass(frozen=True)
class Declared:
    """A timestamp format declared for files whose name matches ``glob``."""

    glob: str
    spec: str

    @property
    def name_pattern(self) -> str:
        return "^" + "".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in self.glob) + "$"

    def read(self, c: Column, reference: Column) -> Column:
        return _KINDS.get(self.spec, lambda c, r: _strftime(self.spec)(c, r))(strip_source(strip_ansi(c)), reference)


def _epoch(digits: int, scale: int):
    def read(c: Column, reference: Column) -> Column:
        n = _pick(c, rf"(?<![0-9])(\d{{{digits}}})(?![0-9])", 1)
        return F.when(n != "", _found(F.timestamp_micros(n.try_cast("long") * scale), F.lit(3 if scale == 1000 else 0)))

    return read


_KINDS = {"rfc3339": lambda c, r: _iso(F.regexp_replace(_pick(c, RFC3339, 1), " ", "T")), "epoch_ms": _epoch(13, 1000), "epoch_s": _epoch(10, 1_000_000)}
_FIELDS = {"Y": r"(\d{4})", "m": r"(\d{2})", "d": r"(\d{2})", "H": r"(\d{2})", "M": r"(\d{2})", "S": r"(\d{2})", "b": "([A-Za-z]{3})", "f": r"(\d{1,9})", "z": r"(Z|[+-]\d{2}:?\d{2})"}


def compile_strftime(spec: str) -> tuple[str, dict[str, int]]:
    """A pattern of the strftime subset, and the group of each field; digits never border on it."""
    if "%" not in spec:
        raise ValueError(f"unknown timestamp format {spec!r}: rfc3339, epoch_ms, epoch_s or a strftime pattern")
    text = spec.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S").replace("%:z", "%z")
    out, groups = "", {}
    for part in re.findall(r"%\.f|%.|%$|[^%]", text, re.S):
        if part == "%%":
            out += "%"
        elif part == "%.f":
            out += r"(?:\.(\d{1,9}))?"
            groups.setdefault("f", len(groups) + 1)
        elif part[0] == "%":
            if part[1:] not in _FIELDS:
                raise ValueError(f"unsupported directive {part!r} in timestamp format {spec!r}")
            if part[1:] in groups:
                raise ValueError(f"directive {part!r} twice in timestamp format {spec!r}")
            out += _FIELDS[part[1:]]
            groups[part[1:]] = len(groups) + 1
        else:
            out += re.escape(part)
    if not groups:
        raise ValueError(f"timestamp format {spec!r} has no directives")
    return rf"(?<![0-9]){out}(?![0-9])", groups


def _strftime(spec: str):
    pattern, groups = compile_strftime(spec)

    def read(c: Column, reference: Column) -> Column:
        part = {f: F.nullif(_pick(c, pattern, g), F.lit("")) for f, g in groups.items()}
        number = lambda f, default: F.coalesce(part[f].try_cast("int"), F.lit(default)) if f in part else F.lit(default)
        h, m, s = number("H", 0), number("M", 0), number("S", 0)
        micros = F.coalesce(F.rpad(F.substring(part["f"], 1, 6), 6, "0").try_cast("long"), F.lit(0)) if "f" in part else F.lit(0)
        digits = F.least(F.coalesce(F.length(part["f"]), F.lit(0)), F.lit(6)) if "f" in part else F.lit(0)
        seconds = h * 3600 + m * 60 + s
        if not {"Y", "m", "d", "b"} & set(part):
            at = on_day_of(seconds, micros, reference)
        else:
            year = number("Y", 0) if "Y" in part else F.year(reference)
            month = number("m", 1) if "m" in part else _month(part["b"]) if "b" in part else F.lit(1)
            day = F.try_to_timestamp(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(number("d", 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")))
            at = F.timestamp_micros(_micros(day) + seconds.cast("long") * 1_000_000 + micros)
        if "z" in part:
            raw = F.regexp_replace(part["z"], ":", "")
            size = F.substring(raw, 2, 2).try_cast("int") * 3600 + F.substring(raw, 4, 2).try_cast("int") * 60
            at = F.when(raw == "Z", at).otherwise(_moved(at, F.when(F.substring(raw, 1, 1) == "-", -size).otherwise(size)))
        good = c.rlike(pattern) & h.between(0, 23) & m.between(0, 59) & s.between(0, 59)
        return F.when(good, _found(at, digits))

    return read


def declarations(raw: str | None) -> list[Declared]:
    """``glob=format; glob=format``; a mistake raises ValueError."""
    out = []
    for entry in filter(None, map(str.strip, (raw or "").split(";"))):
        glob, eq, spec = (x.strip() for x in entry.partition("="))
        if not eq or not glob or not spec:
            raise ValueError(f"expected glob=format, got {entry!r}")
        if spec not in _KINDS:
            compile_strftime(spec)
        out.append(Declared(glob, spec))
    return out


def declared_time(formats: Sequence[Declared], file: Column, c: Column, reference: Column) -> Column | None:
    """(at, digits) by the first declaration whose glob matches the file's name."""
    if not formats:
        return None
    first, *rest = formats
    got = F.when(file.rlike(first.name_pattern), first.read(c, reference))
    for d in rest:
        got = got.when(file.rlike(d.name_pattern), d.read(c, reference))
    return got
