"""Time arguments and windows, parsed on the driver into plain values."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
_ISO = re.compile(r"(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(Z|z|[+-]\d{2}(?::?\d{2})?)", re.ASCII)


def now_utc() -> datetime:
    return datetime.now(timezone.utc)


def parse_iso(value: str) -> datetime | None:
    """An instant with a zone, to the microsecond; anything else is None."""
    m = _ISO.fullmatch(value)
    if not m:
        return None
    day, clock, fraction, zone = m.groups()
    try:
        at = datetime.fromisoformat(f"{day}T{clock}").replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    at += timedelta(microseconds=int((fraction or "0")[:6].ljust(6, "0")))
    if zone not in "Zz":
        digits = zone[1:].replace(":", "").ljust(4, "0")
        shift = timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
        at += shift if zone[0] == "-" else -shift
    return at


def duration_seconds(value: str, units: str = "smhdw", least: int = 0) -> int:
    """Seconds of a duration such as 15m; ValueError if it isn't one or is under ``least``."""
    m = re.fullmatch(rf"(\d+)([{units}])", value.strip(), re.ASCII) if isinstance(value, str) else None
    seconds = int(m[1]) * UNIT_SECONDS[m[2]] if m else -1
    if seconds < least:
        raise ValueError(f"not a duration: {value!r}")
    return seconds


def instant(value: str | datetime | None, now: datetime | None = None) -> datetime | None:
    """A bound: ISO 8601 with a zone, or a duration before ``now``; None stays None, anything else raises ValueError."""
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    at = parse_iso(value)
    if at is None:
        try:
            at = (now or now_utc()) - timedelta(seconds=duration_seconds(value))
        except ValueError:
            raise ValueError(f"not a time: {value!r} (ISO 8601 with a zone, or a duration such as 30m)") from None
    return at


@dataclass(frozen=True)
class Around:
    """Seconds before and after an anchor."""

    before: int = 30
    after: int = 30

    @property
    def label(self) -> str:
        return f"±{self.before}s" if self.before == self.after else f"-{self.before}s/+{self.after}s"


def around(spec: str | dict | None) -> Around:
    """``±10s`` (also ``+-10s``, ``+/-10s``), ``{before, after}`` or the default."""
    if spec is None:
        return Around()
    if isinstance(spec, dict):
        if spec.get("before") is None and spec.get("after") is None:
            raise ValueError("a window needs before or after")
        return Around(*(duration_seconds(spec.get(side) or "0s", "smhd") for side in ("before", "after")))
    m = re.fullmatch(r"(?:±|\+-|\+/-)\s*(\d+[smhd])", spec.strip(), re.ASCII)
    if not m:
        raise ValueError(f"not a window: {spec!r} (such as ±10s, or before and after)")
    seconds = duration_seconds(m[1], "smhd")
    return Around(seconds, seconds)


@dataclass(frozen=True)
class DiffBounds:
    """Window [since, until] and baseline [baseline, since)."""

    baseline: datetime
    since: datetime
    until: datetime


def diff_bounds(window: str | None = None, since: str | None = None, until: str | None = None, baseline: str | None = None, now: datetime | None = None) -> DiffBounds:
    now = now or now_utc()
    end = instant(until, now) or now
    if window:
        length = duration_seconds(window, least=1)
        start = end - timedelta(seconds=length)
    elif since:
        start = instant(since, now)
        length = int((end - start).total_seconds())
        if length <= 0:
            raise ValueError("the window is empty: until must be after since")
    else:
        raise ValueError("window or since is required")
    back = duration_seconds(baseline, least=1) if baseline else length
    return DiffBounds(start - timedelta(seconds=back), start, end)
