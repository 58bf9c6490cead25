"""Small text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rstrip(c: Column) -> Column:
    """Without white space at the end, Unicode's included."""
    return F.regexp_replace(c, r"(?U)\s+$", "")


def any_case(pattern: str) -> str:
    """A pattern that ignores case; ValueError if it doesn't compile."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from None
    return f"(?i){pattern}"


def literal(text: str) -> str:
    """A pattern of just this text."""
    return re.sub(r"([^0-9A-Za-z_])", r"\\\1", text)


def key_value(c: Column, field: str) -> Column:
    """The first value of ``field=value`` or ``field: value``, or null."""
    return F.nullif(F.regexp_extract(c, literal(field) + r"[=:]\s*([^\s,;]+)", 1), F.lit(""))


def human_bytes(c: Column) -> Column:
    kilo, mega = 1024.0, 1024.0 * 1024.0
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < mega, F.concat(F.round(c / kilo, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(c / mega, 1).cast("string"), F.lit(" MB")))


def human_span(seconds: Column) -> Column:
    """2d 3h 15m 4s; without empty parts, 0s for none."""
    s = F.abs(seconds.cast("long"))
    parts = [(F.floor(s / 86_400), "d"), (F.floor(s / 3600) % 24, "h"), (F.floor(s / 60) % 60, "m"), (s % 60, "s")]
    text = F.concat_ws(" ", *[F.when(n > 0, F.concat(n.cast("long").cast("string"), F.lit(unit))) for n, unit in parts])
    return F.when(seconds.isNotNull(), F.when(text == "", "0s").otherwise(text))
