import json
import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quarrylog.functions import entries
from quarrylog.functions.leaves import any_leaf_contains
from quarrylog.functions.severity import Patterns, line_level
from quarrylog.functions.template import TOKENS, template, template_hash
from quarrylog.functions.text import human_bytes, human_span, key_value, literal, rstrip
from quarrylog.functions.timeargs import around, diff_bounds, duration_seconds, instant, parse_iso
from quarrylog.functions.timestamps import Declared, compile_strftime, declarations, declared_time, entry_time, iso_text, line_time, source_of
from quarrylog.session import configure

UTC = timezone.utc


def column(spark, values, f, kind="string"):
    configure(spark)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.select(f(F.col("c")).alias("x"), "i").orderBy("i").select("x").collect()]


LINES = [
    ("2026-03-20T14:00:00.123Z some log message", None, "2026-03-20T14:00:00.123Z"),
    ("2026-03-20T14:00:00+05:30 log entry", None, "2026-03-20T08:30:00Z"),
    ("2026-03-20T14:00:00+0530 log entry", None, "2026-03-20T08:30:00Z"),
    ("[2026-03-20T14:00:00.123Z] INFO: started", None, "2026-03-20T14:00:00.123Z"),
    ('10.0.0.1 - - [20/Mar/2026:14:00:00 +0530] "POST /api"', None, "2026-03-20T08:30:00Z"),
    ('10.0.0.1 - - [20/Mar/2026:14:00:00 -0330] "POST /api"', None, "2026-03-20T17:30:00Z"),
    ("2026-03-20 14:00:00 ERROR at 09:00:00", None, "2026-03-20T14:00:00Z"),
    ("Jan  5 09:30:15 server kernel: message", None, "2026-01-05T09:30:15Z"),
    ("2026-03-20 some text", None, None),
    ("", None, None),
    ("2026-13-20T14:00:00Z bad month, but [09:00:00]", "2026-03-20T15:00:00Z", "2026-03-20T09:00:00Z"),
    ("14:00:00 [vite] hmr update", "2026-03-20T15:00:00Z", "2026-03-20T14:00:00Z"),
    ("[14:00:00] page reload", "2026-03-20T15:00:00Z", "2026-03-20T14:00:00Z"),
    ("[vite] 14:00:00 hmr", "2026-03-20T15:00:00Z", "2026-03-20T14:00:00Z"),
    ("2:00:00 PM [vite] hmr update", "2026-03-20T15:00:00Z", "2026-03-20T14:00:00Z"),
    ("12:00:00 AM start", "2026-03-20T15:00:00Z", "2026-03-20T00:00:00Z"),
    ("13:00:00 PM no such hour", "2026-03-20T15:00:00Z", None),
    ("finished at 14:00:00 today", "2026-03-20T15:00:00Z", None),
    ("23:50:00 before midnight", "2026-03-21T00:30:00Z", "2026-03-20T23:50:00Z"),
    ("00:20:00 after midnight", "2026-03-21T00:30:00Z", "2026-03-21T00:20:00Z"),
    ("\x1b[2m14:00:00\x1b[0m \x1b[36m[vite]\x1b[0m hmr", "2026-03-20T15:00:00Z", "2026-03-20T14:00:00Z"),
    ("[src:fly] 2026-03-20T14:00:00Z tagged", None, "2026-03-20T14:00:00Z"),
    ("25:61:00 no time", "2026-03-20T15:00:00Z", None),
]


def test_line_times(spark):
    configure(spark)
    df = spark.createDataFrame([(k, c, parse_iso(r or "2026-03-20T23:00:00Z")) for k, (c, r, _) in enumerate(LINES)], "i int, c string, r timestamp")
    got = df.select("i", iso_text(line_time(F.col("c"), F.col("r"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [w for *_, w in LINES]


DECLARED = [
    ("2026-03-20T14:00:00Z evt=1742479200123", "epoch_ms", "2025-03-20T14:00:00.123Z"),
    ("evt=17424792001234", "epoch_ms", None),
    ("at 1742479200 s", "epoch_s", "2025-03-20T14:00:00Z"),
    ("2026-03-20 14:00:00 +0530 x", "%Y-%m-%d %H:%M:%S %z", "2026-03-20T08:30:00Z"),
    ("2026-03-20T14:00:00.5Z x", "%FT%T%.fZ", "2026-03-20T14:00:00.5Z"),
    ("2026-03-20T14:00:00Z x", "%FT%T%.fZ", "2026-03-20T14:00:00Z"),
    ("Mar 05 01:02:03 x", "%b %d %H:%M:%S", "2026-03-05T01:02:03Z"),
    ("114:00:005", "%H:%M:%S", None),
    ("x 10:00:00 y", "%H:%M:%S", "2026-03-20T10:00:00Z"),
    ("2026-02-30 10:00:00", "%F %T", None),
    ("2026-03-20 14:00:00", "rfc3339", "2026-03-20T14:00:00Z"),
]


def test_declared_times(spark):
    for line, spec, want in DECLARED:
        got = column(spark, [line], lambda c: iso_text(declared_time([Declared("*.log", spec)], F.lit("a.log"), c, F.lit(datetime(2026, 3, 20, 23, tzinfo=UTC)))))
        assert got == [want], (line, spec)


def test_declarations():
    assert [d.spec for d in declarations("fly-*.log=%FT%T%.fZ; app?.log=epoch_ms")] == ["%FT%T%.fZ", "epoch_ms"]
    for bad in ("x", "a.log=", "=epoch_ms", "a.log=%Q", "a.log=nothing", "a.log=%H%"):
        with pytest.raises(ValueError):
            declarations(bad)
    assert compile_strftime("%H:%M")[1] == {"H": 1, "M": 2}


def test_entry_times_need_a_zone(spark):
    values = ["2026-01-15T10:30:00.123Z", "2026-01-15T10:30:00", "2026-01-15T10:30:00+02:00", None, "soon"]
    assert column(spark, values, lambda c: iso_text(entry_time(c))) == ["2026-01-15T10:30:00.123Z", None, "2026-01-15T08:30:00Z", None, None]


TEMPLATES = [
    ("2026-07-17T10:00:00.123Z ERROR conn lost", "<TS> ERROR conn lost"),
    ('127.0.0.1 - - [20/Mar/2026:14:00:00 +0000] "GET /health" 200', '<IP> - - [<TS>] "GET /health" <N>'),
    ("Mar 20 14:00:00 host sshd[123]: auth fail", "<TS> host sshd[<N>]: auth fail"),
    ("user 550e8400-e29b-41d4-a716-446655440000 logged in", "user <UUID> logged in"),
    ("connect to 10.0.0.7:5432 refused", "connect to <IP> refused"),
    ("segfault at 0xDEADBEEF", "segfault at <HEX>"),
    ("req a3f9c2d871b4 done", "req <HEX> done"),
    ("order 12345678 shipped", "order <N> shipped"),
    ("deadbeef is a word here", "deadbeef is a word here"),
    ("lost after 30s, took 1300ms", "lost after <N>s, took <N>ms"),
    ("handler error404 fired", "handler error404 fired"),
    ("[src:fly-a] conn 4f9a12cd lost after 30s", "conn <HEX> lost after <N>s"),
    ("12026-07-17T10:00:00 x", "<N>-<N>-<N>T10:<N>:<N> x"),
    ("", ""),
    ("a \x01 mark 5 and 10.0.0.7 \x01", "a \x01 mark <N> and <IP> \x01"),
    ("café1 took 5", "café<N> took <N>"),
]


def test_templates(spark):
    assert column(spark, [a for a, _ in TEMPLATES], template) == [b for _, b in TEMPLATES]
    assert column(spark, ["said \"hello world\" and 'bye'"], lambda c: template(c, quoted=True)) == ["said <STR> and <STR>"]
    assert len(column(spark, ["x"], template_hash)[0]) == 8


def plain_template(line):
    """One pass from left to right, by the alternative that matched."""
    names = ("<TS>", "<TS>", "<TS>", "<UUID>", "<IP>", "<HEX>", "<TS>", "<N>")
    pattern = re.compile("|".join(f"({t})" for t in TOKENS), re.ASCII)

    def stands(m):
        name = names[m.lastindex - 1]
        if name == "<HEX>" and not re.search("[xX]", m[0]):
            return "<N>" if m[0].isdigit() else name if re.search("[0-9]", m[0]) else m[0]
        return name

    return pattern.sub(stands, line).strip()


def test_templates_against_one_pass(spark):
    rng = random.Random(4)
    parts = ["2026-03-20T14:00:00.5Z", "2026-03-20 14:00:00", "20/Mar/2026:14:00:00 +0100", "Mar  3 14:00:00", "deadbeef", "deadbeef01", "0xBEEF", "1b4e28ba-2fa1-11d2-883f-0016d3cca427", "10.0.0.1:8080", "192.168.1.300", "14:00:00.25 PM", "3:04:05", "42", "4.5", "x1", "v2.1.0", "Decade", "abcdef", "facade99", "=", ":", "-", ".", " ", " ", "_", "/", "\x01", "\x02", "\x03", "é", "A", "12", "00"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    got = column(spark, lines, template)
    assert [(a, b) for a, b in zip(lines, got)] == [(a, plain_template(a)) for a in lines]


def test_levels(spark):
    lines = ["INFO Request", "WARN slow", "ERROR x", "FATAL oom", "Timeout on upstream", "information only", "debug x", "[trace] y", "nothing", "deprecated", "PANIC and error"]
    assert column(spark, lines, line_level) == ["info", "warn", "error", "fatal", "warn", None, "debug", "trace", None, "warn", "fatal"]
    assert column(spark, ["boom", "WARN"], lambda c: line_level(c, Patterns(extra="boom", warn="never"))) == ["error", None]


JSON = [
    '{"severity":"ERROR","message":"Connection refused","timestamp":"2026-01-15T10:30:00.123Z"}',
    '{"level":30,"time":1705312200000,"msg":"Server started","pid":1}',
    '{"level":99,"msg":7}',
    '{"log":{"level":"DEBUG"},"textPayload":"t"}',
    '{"severity":null,"levelname":"CRITICAL","message":false,"msg":"m"}',
    "[1]", "plain", '{"a":1,"a":2}',
]


def test_entries(spark):
    assert column(spark, JSON, lambda c: entries.severity(entries.entry(c))) == ["error", "info", "unknown", "debug", "critical", None, None, None]
    assert column(spark, JSON, lambda c: entries.message(entries.entry(c))) == ["Connection refused", "Server started", "7", "t", "m", None, None, None]
    assert column(spark, JSON, lambda c: entries.timestamp_text(entries.entry(c)))[:2] == ["2026-01-15T10:30:00.123Z", "2024-01-15T09:50:00.000Z"]
    assert column(spark, JSON, lambda c: entries.entry(c).isNotNull()) == [True, True, True, True, True, False, False, True]


def test_fields(spark):
    rows = ['{"a":{"b":{"c":1}},"items":[{"id":1}],"flat":null,"0":{"1":"k"}}']
    value = lambda f: column(spark, rows, lambda c: entries.as_text(entries.value(entries.entry(c), f)))[0]
    assert [value(f) for f in ("a.b.c", "a.b", "items.0.id", "items.1", "flat", "missing", "0.1", "a.b.c.d")] == ["1", '{"c":1}', "1", None, "null", None, "k", None]


def test_leaves(spark):
    rows = ['{"a":["x-7",{"b":"say \\"x-7\\" now"}]}', '{"x-7":1}', '{"n":7}', None]
    assert column(spark, rows, lambda c: any_leaf_contains(F.try_parse_json(c), "x-7")) == [True, False, False, False]
    assert column(spark, rows, lambda c: any_leaf_contains(F.try_parse_json(c), 'y "x')) == [True, False, False, False]


def test_leaves_with_awkward_strings(spark):
    """Against a walk over the decoded entries: quotes, backslashes, colons and commas in keys and values, at any depth."""
    rng = random.Random(6)
    pieces = ['"', "\\", ":", ",", "a", "é", "\n", "{", "}", " ", "x:y", '","']

    def made(depth):
        text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(4)))
        kind = rng.randrange(5 if depth else 2)
        return text() if kind < 2 else rng.choice([1, 2.5, True, None]) if kind == 2 else {text(): made(depth - 1) for _ in range(3)} if kind == 3 else [made(depth - 1) for _ in range(3)]

    def leaves(x):
        return [x] if isinstance(x, str) else [y for z in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()) for y in leaves(z)]

    entries_ = [{str(k): made(3) for k in range(3)} for _ in range(300)]
    rows = [json.dumps(x, ensure_ascii=rng.random() < 0.5) for x in entries_]
    for wanted in ('"', "\\", "a", ':"', "é,", '\\"', "x:y", "\n", '","', "0"):
        want = [any(wanted in y for y in leaves(x)) for x in entries_]
        assert column(spark, rows, lambda c: any_leaf_contains(F.try_parse_json(c), wanted)) == want, wanted  # noqa: B023


def test_text(spark):
    assert column(spark, ["a=1, b", "x a: v;", "none"], lambda c: key_value(c, "a")) == ["1", "v", None]
    assert column(spark, ["x \t\r", " y "], rstrip) == ["x", " y"]
    assert column(spark, [0, 1023, 1536, 5 * 1048576], human_bytes, "long") == ["0 B", "1023 B", "1.5 KB", "5.0 MB"]
    assert column(spark, [0, 4, 3600, 184504, -60], human_span, "long") == ["0s", "4s", "1h", "2d 3h 15m 4s", "1m"]
    assert column(spark, ["[src:web-1] x", "[vite] x"], source_of) == ["web-1", None]
    assert column(spark, ["a.b(c)"], lambda c: c.rlike(f"^{literal('a.b(c)')}$")) == [True]


def test_time_arguments():
    now = datetime(2026, 1, 2, tzinfo=UTC)
    assert instant("2h", now) == datetime(2026, 1, 1, 22, tzinfo=UTC) and instant(None) is None
    assert instant("2026-01-01T00:00:00+02:00") == datetime(2025, 12, 31, 22, tzinfo=UTC)
    for bad in ("soon", "2026-01-01T00:00:00", "5x"):
        with pytest.raises(ValueError):
            instant(bad)
    assert duration_seconds("1w") == 604_800
    assert (around(None).before, around("±2m").after, around("+-10s").before, around("+/-10s").label) == (30, 120, 10, "±10s")
    assert around({"after": "5s"}).label == "-0s/+5s"
    for bad in ("10s", {}, {"before": "1w"}):
        with pytest.raises(ValueError):
            around(bad)
    b = diff_bounds("15m", until="2026-07-17T10:30:00Z")
    assert (b.since.minute, b.baseline.minute) == (15, 0)
    for bad in (dict(), dict(window="0s"), dict(since="2026-01-03T00:00:00Z", until="2026-01-02T00:00:00Z"), dict(window="1h", baseline="x")):
        with pytest.raises(ValueError):
            diff_bounds(now=now, **bad)
