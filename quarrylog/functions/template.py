"""Message templates: volatile tokens of a line become placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timestamps import ANSI, MONTHS, SOURCE_TAG, let

# Volatile tokens in order of precedence.  Word boundaries are of ASCII words only.
B, E = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
MONTH = f"(?:{'|'.join(MONTHS)})"
TOKENS = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?",
    rf"\d{{2}}/{MONTH}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}(?: [+-]\d{{4}})?",
    rf"{MONTH}\s+\d{{1,2}} \d{{1,2}}:\d{{2}}:\d{{2}}",
    rf"{B}[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}{E}",
    rf"{B}\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?::\d{{1,5}})?{E}",
    rf"{B}0[xX][0-9a-fA-F]+{E}|{B}[0-9a-fA-F]{{8,}}{E}",
    rf"{B}\d{{1,2}}:\d{{2}}:\d{{2}}(?:\.\d+)?(?: ?[AP]M)?{E}",
    rf"{B}\d+(?:\.\d+)?",
)
QUOTED = "\"[^\"]*\"|'[^']*'"
#: What stands around a token while its kind is sought; a line that has one of them is marked with the next pair.
MARKS = (("\x01", "\x02"), ("\x03", "\x04"), ("", ""), ("﷐", "﷑"))


def _any_token(quoted: bool) -> str:
    """The tokens as one pattern.  What a token can start with is looked at before its alternatives: most places have none."""
    stamps, month, words = TOKENS[:2], TOKENS[2], [t.replace(B, "") for t in TOKENS[3:]]
    letters = "".join(sorted({m[0] for m in MONTHS} | set("ABCDEFabcdef")))
    of_letters = [words[0], rf"[0-9a-fA-F]{{8,}}+{E}"]  # what can start with a letter
    starts = [rf"(?=[0-9])(?:{'|'.join(stamps)}|{B}(?:{'|'.join(words)}))", rf"(?=[{letters}])(?:{month}|{B}(?:{'|'.join(of_letters)}))"]
    return "|".join(([QUOTED] if quoted else []) + starts)


def _kinds(mark: str, end: str, quoted: bool) -> list[tuple[str, str]]:
    """(pattern of a marked token, what stands for it), to be tried in order; a token of no kind stays."""
    one = lambda inner: f"{mark}{inner}{end}"
    rest = f"[^{end}]*"
    return [
        (one(r"[0-9]+(?:\.[0-9]+)?"), "<N>"),
        *([(one(f"[\"']{rest}"), "<STR>")] if quoted else []),
        (one(f"{rest}:{rest}:{rest}"), "<TS>"),
        (one(f"[^{end}]{{8}}-[^{end}]{{4}}-[^{end}]{{4}}-[^{end}]{{4}}-[^{end}]{{12}}"), "<UUID>"),
        (one(f"0[xX]{rest}"), "<HEX>"),
        (one(f"(?:{rest}:{rest}|[0-9.]+)"), "<IP>"),
        (one(f"{rest}[0-9]{rest}"), "<HEX>"),
    ]


def template(c: Column, quoted: bool = False) -> Column:
    """The line with timestamps, UUIDs, addresses, hex ids and numbers replaced; quoted strings too on request.

    One pass marks the tokens, short ones name them by their shape: generated
    code throughout, and the long pattern runs once.  A line that holds all of
    the MARKS keeps its tokens.
    """
    c = F.when(c.contains("\x1b"), F.regexp_replace(c, ANSI, "")).otherwise(c)
    c = F.when(c.startswith("[src:"), F.regexp_replace(c, SOURCE_TAG, "")).otherwise(c)
    out = c
    for mark, end in reversed(MARKS[1:]):
        out = F.when(~c.contains(mark) & ~c.contains(end), _filled(c, mark, end, quoted)).otherwise(out)
    mark, end = MARKS[0]
    got = F.when(~c.contains(mark) & ~c.contains(end), _filled(c, mark, end, quoted)).otherwise(out)
    return F.trim(F.regexp_replace(got, r"(?U)^\s+|\s+$", ""))


def _filled(c: Column, mark: str, end: str, quoted: bool) -> Column:
    x = F.regexp_replace(c, f"({_any_token(quoted)})", f"{mark}$1{end}")
    kinds = _kinds(mark, end, quoted)
    for pattern, name in kinds[:-4]:
        x = F.regexp_replace(x, pattern, name)

    def rest(x: Column) -> Column:
        y = x
        for pattern, name in kinds[-4:]:
            y = F.regexp_replace(y, pattern, name)
        return F.when(x.contains(mark), F.translate(y, mark + end, "")).otherwise(x)

    return let(x, rest)  # most lines have numbers and timestamps only


def template_hash(t: Column) -> Column:
    """Eight hex digits of a template."""
    return F.lpad(F.lower(F.hex(F.crc32(t.cast("binary")))), 8, "0")
