"""Search of string leaves at any depth: SQL can't recurse into a VARIANT, but in its JSON text every string stands between quotes."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timestamps import let

#: Stand for an escaped backslash and an escaped quote; JSON text never holds these characters as they are.
BACKSLASH, QUOTE = "\x01", "\x02"


def _bare(json_text: Column) -> Column:
    """JSON text whose only quotes are those around strings."""
    return F.replace(F.replace(json_text, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))


def any_leaf_contains(v: Column, wanted: str) -> Column:
    """Whether any string value of an entry, at any depth, contains ``wanted``; keys and numbers don't count.

    Split at the quotes, every second part of the text is a string, and a key if
    a colon follows.  Only entries whose JSON contains the text are split.
    """
    escaped = json.dumps(wanted, ensure_ascii=False)[1:-1].replace("\\\\", BACKSLASH).replace('\\"', QUOTE)

    def leaf(parts: Column) -> Column:
        is_value = lambda k: ~F.coalesce(F.get(parts, k + 1).startswith(":"), F.lit(False))
        held = F.transform(parts, lambda x, k: (k % 2 == 1) & x.contains(escaped) & is_value(k))
        return F.exists(held, lambda x: x)

    def search(text: Column) -> Column:
        return F.when(text.contains(escaped), let(F.split(text, '"', -1), leaf)).otherwise(False)

    return F.coalesce(let(_bare(F.to_json(v)), search), F.lit(False))
