"""Severity of log lines and of JSON entries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels from low to high, default patterns, names in JSON entries, and numeric levels.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")
DEFAULTS = {
    "fatal": "FATAL|PANIC|OOMKilled|SIGKILL",
    "error": "ERROR|EXCEPTION|TypeError|ReferenceError|SyntaxError|ECONNREFUSED|ENOTFOUND|UnhandledPromiseRejection",
    "warn": "WARN|WARNING|deprecated|timeout",
}
ENTRY_LEVELS = {"fatal": "fatal", "error": "error", "exception": "error", "warn": "warn", "warning": "warn", "info": "info", "debug": "debug", "trace": "trace"}
NUMERIC = {10: "trace", 20: "debug", 30: "info", 40: "warn", 50: "error", 60: "fatal"}


@dataclass(frozen=True)
class Patterns:
    """Patterns of the three levels that can be set; ``extra`` adds to error."""

    fatal: str = DEFAULTS["fatal"]
    error: str = DEFAULTS["error"]
    warn: str = DEFAULTS["warn"]
    extra: str | None = None

    def __post_init__(self) -> None:
        for p in (self.fatal, self.error, self.warn, self.extra):
            re.compile(p or "")


def ordinal(name: str) -> int:
    if name not in LEVELS:
        raise ValueError(f"unknown level {name!r}: one of {', '.join(LEVELS)}")
    return LEVELS.index(name)


def line_level(c: Column, patterns: Patterns = Patterns()) -> Column:
    """The highest level whose pattern is in a line, or null."""
    error = patterns.error + (f"|{patterns.extra}" if patterns.extra else "")
    got = F.when(c.rlike(f"(?i)({patterns.fatal})"), "fatal").when(c.rlike(f"(?i)({error})"), "error").when(c.rlike(f"(?i)({patterns.warn})"), "warn")
    for name in ("info", "debug", "trace"):
        got = got.when(c.rlike(f"(?i)(?<![0-9A-Za-z_]){name}(?![0-9A-Za-z_])"), name)
    return got


def line_at_least(c: Column, level: str, patterns: Patterns = Patterns()) -> Column:
    """Whether a line's level is ``level`` or a higher one: one pattern of all that count."""
    words = [rf"(?<![0-9A-Za-z_]){name}(?![0-9A-Za-z_])" for name in ("info", "debug", "trace")]
    by_level = dict(zip(("fatal", "error", "warn", "info", "debug", "trace"), [patterns.fatal, patterns.error, patterns.warn, *words]))
    found = [p for name, p in by_level.items() if ordinal(name) >= ordinal(level)]
    if patterns.extra and ordinal("error") >= ordinal(level):
        found.append(patterns.extra)
    if any(re.search(r"\\[1-9k]|\(\?[a-zA-Z]", p) for p in found):  # groups or flags of their own: one by one
        hit = c.rlike(f"(?i)({found[0]})")
        for p in found[1:]:
            hit = hit | c.rlike(f"(?i)({p})")
        return hit
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in found))


def entry_level(severity: Column) -> Column:
    """The level that a JSON entry's severity names, or null."""
    got = F.when(severity == "fatal", "fatal")
    for name, level in list(ENTRY_LEVELS.items())[1:]:
        got = got.when(severity == name, level)
    return got


def level_ordinal(level: Column) -> Column:
    got = F.when(level == LEVELS[0], 0)
    for k, name in enumerate(LEVELS[1:], 1):
        got = got.when(level == name, k)
    return got


def numeric_level(n: Column) -> Column:
    got = F.when(n == 10, "trace")
    for k, name in list(NUMERIC.items())[1:]:
        got = got.when(n == k, name)
    return F.when(n.isNotNull(), F.coalesce(got, F.lit("unknown")))
