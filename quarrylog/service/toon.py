"""A table encoding for small results: a header of sorted keys, one line for each row."""

from __future__ import annotations

import json
from collections.abc import Sequence


def plain(value: object) -> object:
    """Values as JSON can hold them."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def to_json(data: object) -> str:
    return json.dumps(plain(data), ensure_ascii=False, separators=(",", ":"))


def cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dict, list, tuple)):
        value = to_json(value)
    return str(value).replace("|", "\\|").replace("\n", "\\n")


def table(rows: Sequence[dict]) -> str:
    """Columns are those of all rows: a key that only later rows have isn't lost."""
    keys = sorted({k for r in rows for k in r})
    return "\n".join(["[" + "|".join(keys) + "]", *("|".join(cell(r.get(k)) for k in keys) for r in rows)])


def respond(data: dict, fmt: str | None = None) -> str:
    """A table where there are matches or entries, with the rest in a comment line before it; JSON on request or without rows."""
    rows = next((data[k] for k in ("matches", "entries") if isinstance(data.get(k), list)), None)
    if fmt == "json" or not rows:
        return to_json(data)
    meta = {k: v for k, v in data.items() if k not in ("matches", "entries") and v is not None}
    return (f"# {to_json(meta)}\n" if meta else "") + table(rows)


def parts(meta: dict, titled: Sequence[tuple[str, Sequence[dict]]], empty: str = "(none)") -> str:
    """Several tables below one comment line."""
    body = "\n\n".join(f"== {title} ==\n" + (table(rows) if rows else empty) for title, rows in titled)
    return f"# {to_json(meta)}\n{body or empty}"
