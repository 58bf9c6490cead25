import sys
import time
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarrylog.operators import fields, scan
from quarrylog.plans.lines import enrich, log_lines, within
from quarrylog.plans.zone_map import extended, pruned, store, stored, zone_map
from quarrylog.session import configure
from quarrylog.sources.files import detect_format, list_files, numbered_lines, remove_old
from quarrylog.sources.ingest import Backoff, RotatingFile, Worker, parse_sources, tokenize
from quarrylog.sources.listings import newer, parse_listing
from quarrylog.streaming.cursor import Cursor, poll_bytes
from quarrylog.streaming.live import live_summary, read_live, run_available

UTC = timezone.utc


def test_formats():
    assert detect_format(b"") == "plain" and detect_format(b"\n \n") == "plain"
    assert detect_format(b"[2026-03-20 14:00:00] INFO x\n") == "plain"
    assert detect_format(b'{"a":1}\n\n{"b":2}\n') == "json_lines" and detect_format(b'{"a":1}\nplain\n') == "plain"
    assert detect_format(b'[{"a":1},{"b":2}]') == "json_array" and detect_format(b'[{"a":1},2]') == "plain"
    assert detect_format(b'[{"a":"' + b"x" * 5000 + b'"}]') == "plain"


@pytest.mark.parametrize("split", [1 << 20, 300])
def test_line_numbers_across_splits(spark, tmp_path, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        want = {}
        for name, n in (("a.log", 700), ("b.log", 1), ("c.log", 0), ("d.log", 333)):
            lines = [f"{name} line {k} " + "x" * (k % 40) if k % 7 else "" for k in range(n)]
            (tmp_path / name).write_text("".join(x + " \r\n" for x in lines))
            want |= {(name, k + 1): x.rstrip() for k, x in enumerate(lines)}
        files = list_files(spark, f"file://{tmp_path}")
        got = {(r.file, r.line_number): r.content for r in numbered_lines(spark, files).collect()}
        assert got == want
        one = [f for f in files if f.name == "a.log"]
        assert {(r.file, r.line_number): r.content for r in numbered_lines(spark, one).collect()} == {k: v for k, v in want.items() if k[0] == "a.log"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_retention(spark, tmp_path):
    import os

    for name, age in (("old.log", 40), ("new.log", 1)):
        (tmp_path / name).write_text("x\n")
        t = time.time() - age * 86_400
        os.utime(tmp_path / name, (t, t))
    assert remove_old(spark, f"file://{tmp_path}", 30) == ["old.log"] and not (tmp_path / "old.log").exists()


def generated(spark, n=2500):
    configure(spark)
    second = F.timestamp_seconds(F.lit(1784246400) + F.col("id"))
    c = F.concat(F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), F.when(F.col("id") % 100 == 0, "ERROR").otherwise("INFO"), F.lit(" request "), F.col("id").cast("string"))
    c = F.when(F.col("id") == 700, "no stamp here").otherwise(c)
    raw = spark.range(n).select(F.lit("a.log").alias("file"), F.lit(0).alias("file_ord"), (F.col("id") + 1).alias("line_number"), c.alias("content"), F.lit("plain").alias("format"), F.lit(datetime(2026, 7, 18, tzinfo=UTC)).alias("mtime"))
    return enrich(raw)


def test_zone_maps_change_no_result(spark, tmp_path):
    lines = generated(spark)
    zones = zone_map(lines, 100)
    for since, until in ((datetime(2026, 7, 17, 0, 25, tzinfo=UTC), None), (None, datetime(2026, 7, 17, 0, 2, tzinfo=UTC)), (datetime(2026, 7, 17, 0, 30, tzinfo=UTC), datetime(2026, 7, 17, 0, 31, tzinfo=UTC))):
        keep = within(F.col("ts_line"), since, until)
        want = {r.line_number for r in lines.where(keep).collect()}
        less = pruned(lines, zones, since, until, size=100)
        assert {r.line_number for r in less.where(keep).collect()} == want and less.count() < 2500 and 701 in want
    store(lines, f"file://{tmp_path}/store", 100)
    got = stored(spark, f"file://{tmp_path}/store", datetime(2026, 7, 17, 0, 25, tzinfo=UTC))
    assert got.count() == lines.where(within(F.col("ts_line"), datetime(2026, 7, 17, 0, 25, tzinfo=UTC), None)).count()
    assert "PushedFilters: [Or(IsNull(ts_line)" in got._jdf.queryExecution().toString()


def test_zone_maps_grow(spark):
    lines = generated(spark, 730)
    before = zone_map(lines.where("line_number <= 450"), 100)
    got = sorted(map(tuple, extended(before, lines, 100).collect()), key=lambda r: r[1])
    assert got == sorted(map(tuple, zone_map(lines, 100).select(before.columns).collect()), key=lambda r: r[1]) and len(got) == 8


def test_results_do_not_depend_on_partitions(spark):
    lines = generated(spark, 600)
    for frame in (lines.repartition(1), lines.repartition(8)):
        got = scan.errors(frame, "error", 3).rows.collect()
        assert [r.line_number for r in got] == [301, 401, 501]


def test_paths(spark, tmp_path):
    configure(spark)
    (tmp_path / "j.log").write_text('{"a":{"b":{"c":1}},"items":[1,2],"flat":"x"}\n{"flat":null}\n')
    got = {r.path: (r.opaque, r.lines) for r in fields.paths(log_lines(spark, list_files(spark, f"file://{tmp_path}"))).collect()}
    assert got == {"a": (False, 1), "a.b": (False, 1), "a.b.c": (False, 1), "items": (True, 1), "flat": (False, 2)}
    known, opaque = set(got), {"items"}
    assert fields.absent(known, opaque, "missing") and fields.absent(known, opaque, "a.zzz")
    assert not fields.absent(known, opaque, "a.b") and not fields.absent(known, opaque, "items.0.id")


def test_cursors():
    first = poll_bytes("f", b"a\nb\n", None)
    more = poll_bytes("f", b"a\nb\nc\nd\ne\n", first.cursor)
    last = poll_bytes("f", b"a\nb\nc\nd\ne\nf\ng", more.cursor)
    assert [x for _, x in first.lines] == ["a", "b"] and more.lines == [(3, "c"), (4, "d"), (5, "e")] and last.lines == [(6, "f"), (7, "g")]
    assert poll_bytes("f", b"a\nb\nc\nd\ne\nf\ngh\n", last.cursor).lines == [(7, "gh")]
    for content, token in ((b"other text\n", more.cursor), (b"a\n", more.cursor), (b"a\nb\n", "rubbish!"), (b"a\nb\n", "e30")):
        got = poll_bytes("f", content, token)
        assert got.reset and got.lines[0][0] == 1
    assert poll_bytes("g", b"a\nb\n", first.cursor).reset and Cursor.decode(first.cursor).lines == 2


def test_polls_neither_overlap_nor_miss():
    content, token, seen = b"", None, []
    for k in range(40):
        content += b"line %d\n" % k * (k % 3)
        got = poll_bytes("f", content, token)
        seen += [n for n, _ in got.lines]
        token = got.cursor
    assert seen == list(range(1, content.count(b"\n") + 1))


def test_listings(spark):
    configure(spark)
    rows = lambda text: spark.createDataFrame([(x,) for x in text.split("\n")], "value string")
    gs = parse_listing(rows("  2276  2026-07-01T10:15:30Z  gs://b/logs/api.log\n 1 2026-07-02T00:00:00Z gs://b/x.log\n 5 notatime gs://b/y.log\nTOTAL: 2 objects"), "gs")
    assert sorted(r.key for r in gs.collect()) == ["gs://b/logs/api.log", "gs://b/x.log"]
    assert [r.key for r in newer(gs, datetime(2026, 7, 1, 10, 15, 30, tzinfo=UTC)).collect()] == ["gs://b/x.log"]
    s3 = parse_listing(rows("2026-07-01 10:15:30       2276 logs/my api.log\n      PRE logs/"), "s3")
    assert [r.key for r in s3.collect()] == ["logs/my api.log"]
    az = parse_listing(rows("logs/api.log\t2026-07-01T10:15:30+00:00\nno tab\n\t2026-07-01T10:15:30+00:00"), "az")
    assert [r.key for r in az.collect()] == ["logs/api.log"]
    with pytest.raises(ValueError):
        parse_listing(rows("x"), "ftp")


def test_source_declarations():
    got = parse_sources("fly:cmd=flyctl logs -a my-app; k8s:cmd=sh -c \"a; b\"")
    assert [(s.name, s.argv) for s in got] == [("fly", ("flyctl", "logs", "-a", "my-app")), ("k8s", ("sh", "-c", "a; b"))]
    assert tokenize(r"""a 'b c' "d \" e" f\ g """) == ["a", "b c", 'd " e', "f g"] and parse_sources(None) == [] and parse_sources(" ; ") == []
    for bad in ("x", "a:b=c", "a b:cmd=x", "a:cmd=", "a:cmd=x;a:cmd=y", "a:cmd='x"):
        with pytest.raises(ValueError):
            parse_sources(bad)


def test_backoff():
    b, queued, seen = Backoff(), 1.0, []
    for _ in range(8):
        delay, queued = b.after(queued, 0)
        seen.append(delay)
    assert seen == [1, 2, 4, 8, 16, 32, 60, 60] and b.after(60, 31) == (1, 2)


def test_rotation(tmp_path):
    f = RotatingFile(tmp_path, "s", most_bytes=10, keep=2)
    for k in range(8):
        f.append(b"line%d\n" % k)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s.1.log", "s.2.log", "s.log"]
    assert (tmp_path / "s.log").read_bytes() == b"line7\n" and (tmp_path / "s.2.log").read_bytes() == b"line5\n"


def test_worker_tags_and_restarts(tmp_path):
    (source,) = parse_sources(f"w:cmd={sys.executable} -c \"print('one'); print('two', end='')\"")
    w = Worker(source, RotatingFile(tmp_path, "w"), sleep=lambda s: None, most_runs=2).start()
    w.join(30)
    assert Path(tmp_path / "w.log").read_text() == "[src:w] one\n[src:w] two\n" * 2 and w.status == "dead" and w.lines == 4


def test_live(spark, tmp_path):
    configure(spark)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "w.log").write_text("".join(f"[src:w] 2026-07-17T10:0{m}:00Z {'ERROR' if m == 3 else 'INFO'} took {m}ms\n" for m in range(6)) + "no stamp\n")
    seen = []
    summary = live_summary(read_live(spark, f"file://{logs}"), "2 minutes")
    for _ in range(2):
        run_available(summary, lambda batch, k: seen.extend(batch.collect()), "update", f"file://{tmp_path}/state")
    assert sum(r.lines for r in seen) == 6 and sum(r.errors for r in seen) == 1 and {r.instance for r in seen} == {"w"}
    assert {r.template for r in seen} == {"<TS> INFO took <N>ms", "<TS> ERROR took <N>ms"}
