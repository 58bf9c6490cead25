"""JSON entries as VARIANT values: decoding, fields and the usual attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .severity import numeric_level
from .timestamps import epoch_millis_text, let

# Where the usual attributes are looked up, first match first.
SEVERITY = ("severity", "level", "log.level", "levelname", "loglevel")
MESSAGE = ("message", "msg", "textPayload", "@message")
TIMESTAMP = ("timestamp", "time", "@timestamp", "receiveTimestamp")


def entry(c: Column) -> Column:
    """The object in a line, or null; other JSON is no entry."""
    return let(F.try_parse_json(c), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def _step(name: str) -> str:
    return "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']" if "'" in name else f"['{name}']"


def path(field: str) -> list[str]:
    """The VARIANT paths a dotted field can mean: numbers are keys or, below the top, places in a list."""
    ways = ["$"]
    for k, part in enumerate(field.split(".")):
        ways = [w + s for w in ways for s in ([_step(part), f"[{part}]"] if part.isdigit() and k else [_step(part)])]
    return ways


def value(v: Column, field: str) -> Column:
    """The value of a field as VARIANT, null only where the field is missing; a JSON null is a value."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.try_variant_get(v, p, "variant") for p in path(field)])


def as_text(v: Column) -> Column:
    """A value as text: null as 'null', text as it is, numbers and booleans in JSON, objects and lists as JSON."""
    def read(v: Column) -> Column:
        return F.when(v.isNull(), None).when(F.is_variant_null(v), "null").when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))

    return let(v, read)


def scalar_text(v: Column, field: str) -> Column:
    """Text of a field for matching: null where it is missing, null, an object or a list."""
    return let(value(v, field), lambda got: F.when(got.isNotNull() & ~F.is_variant_null(got) & ~F.schema_of_variant(got).rlike("^(OBJECT|ARRAY)"), as_text(got)))


def _set(v: Column) -> Column:
    """Neither missing nor null nor false."""
    return let(v, lambda x: F.when(~F.is_variant_null(x) & (F.to_json(x) != "false"), x))


def _first(v: Column, fields: tuple[str, ...]) -> Column:
    return F.coalesce(*[_set(value(v, f)) for f in fields])


def severity(v: Column) -> Column:
    """Lower-case severity; numbers by the numeric levels; other kinds null."""
    def read(got: Column) -> Column:
        kind = F.schema_of_variant(got)
        return F.when(kind == "STRING", F.lower(F.try_variant_get(got, "$", "string"))).when(kind == "BIGINT", let(F.try_variant_get(got, "$", "long"), numeric_level))

    return let(_first(v, SEVERITY), read)


def message(v: Column) -> Column:
    return as_text(_first(v, MESSAGE))


def timestamp_text(v: Column) -> Column:
    """The timestamp as text: text as written, integers as epoch milliseconds, other kinds null."""
    def read(got: Column) -> Column:
        kind = F.schema_of_variant(got)
        return F.when(kind == "STRING", F.try_variant_get(got, "$", "string")).when(kind == "BIGINT", epoch_millis_text(F.try_variant_get(got, "$", "long")))

    return let(_first(v, TIMESTAMP), read)


def content(v: Column) -> Column:
    """The message, or the whole entry as JSON."""
    return F.coalesce(message(v), F.to_json(v))
