"""The line store changes what is read, and no result."""

import json
import os
import re
from datetime import datetime, timezone

import pytest

from quarrylog.operators import groups
from quarrylog.plans.line_store import LineStore
from quarrylog.service.tools import Tools
from quarrylog.sources.files import list_files
from quarrylog.streaming.cursor import COUNT_HERE, Cursor, poll, poll_bytes

NOW = datetime(2026, 7, 17, 12, tzinfo=timezone.utc)
PLAIN = "".join(f"2026-07-17T{8 + k // 60:02}:{k % 60:02}:00Z {'ERROR' if k % 9 == 0 else 'WARN' if k % 7 == 0 else 'INFO'} request {k} handled\n" if k % 11 else "  a line without a stamp, ERROR\n" for k in range(200))
LATE = "".join(f"2026-07-17 11:{k:02}:00 ERROR disk {k} full\n" for k in range(50))
ENTRIES = "".join(json.dumps({"severity": "error" if k % 5 == 0 else "info", "message": f"job {k} done", "timestamp": f"2026-07-17T{9 + k // 60:02}:{k % 60:02}:00Z", "user": {"id": k % 3}}) + "\n" for k in range(120)) + "no json\n"
ARRAY = json.dumps([{"level": "warn", "msg": f"item {k}", "time": f"2026-07-17T10:{k:02}:00Z"} for k in range(20)])
FILES = {"a.log": PLAIN, "b.log": LATE, "c.log": ENTRIES, "d.log": ARRAY, "e.log": ""}
CALLS = [
    ("get_errors", {"file": "a.log", "level": "error", "since": "2026-07-17T09:00:00Z", "until": "2026-07-17T10:00:00Z"}),
    ("get_errors", {"file": "c.log", "level": "info", "since": "2026-07-17T10:30:00Z"}),
    ("get_errors", {"file": "b.log", "until": "2026-07-17T08:00:00Z"}),
    ("all_errors", {"since": "2026-07-17T10:05:00Z", "until": "2026-07-17T11:10:00Z"}),
    ("all_errors", {"rollup": True, "since": "2026-07-17T10:05:00Z"}),
    ("search_logs", {"file": "a.log", "pattern": "request 9", "since": "2026-07-17T09:00:00Z", "context": 2}),
    ("search_logs", {"file": "c.log", "pattern": "job 1", "until": "2026-07-17T09:30:00Z"}),
    ("search_logs", {"file": "d.log", "pattern": "item", "since": "2026-07-17T10:05:00Z"}),
    ("search_logs", {"file": "c.log", "field": "user.id", "pattern": "2", "since": "2026-07-17T10:00:00Z"}),
    ("tail_log", {"file": "a.log", "lines": 7, "since": "2026-07-17T11:00:00Z"}),
    ("aggregate", {"file": "c.log", "field": "user.id", "op": "values", "since": "2026-07-17T10:00:00Z"}),
    ("aggregate", {"file": "c.log", "field": "severity", "op": "exists", "until": "2026-07-17T09:10:00Z"}),
    ("aggregate", {"file": "c.log", "field": "user.name", "op": "exists"}),
    ("aggregate", {"field": "nowhere", "op": "count"}),
    ("aggregate", {"file": "c.log", "field": "user", "op": "exists"}),
    ("summarize", {"since": "2026-07-17T10:30:00Z", "until": "2026-07-17T11:30:00Z", "baseline": "60m"}),
]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """Tools over the files, and tools over them and a store."""
    log_dir = tmp_path_factory.mktemp("logs")
    for name, text in FILES.items():
        (log_dir / name).write_text(text)
    store = LineStore(spark, f"file://{tmp_path_factory.mktemp('store')}")
    plain, stored = (Tools(spark, f"file://{log_dir}", now=NOW, store=s) for s in (None, store))
    assert store.refresh(list_files(spark, f"file://{log_dir}")) == sorted(FILES)
    return log_dir, plain, stored


@pytest.mark.parametrize("name,arguments", CALLS)
def test_same_results(both, name, arguments):
    _, plain, stored = both
    assert stored.call(name, arguments) == plain.call(name, arguments)


def test_filters_are_pushed(both, spark):
    _, _, stored = both
    files = list_files(spark, stored.log_dir)
    plan = stored.store.lines(files[:1], NOW, None)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*Or\(IsNull\(ts_line\),GreaterThanOrEqual\(ts_line", plan)
    assert {r.content for r in stored.store.lines(files[:1], NOW, None).select("content").collect()} == {"  a line without a stamp, ERROR"}


def test_a_field_that_no_line_has_is_not_sought(both, spark):
    _, _, stored = both
    files = [f for f in list_files(spark, stored.log_dir) if f.name == "c.log"]
    assert stored.store.totals_without(files, "user.name") == {"entries": 120, "others": 1}
    assert stored.store.totals_without(files, "user.id") is None and stored.store.totals_without([], "x") is None


def test_changed_files_are_read_until_refreshed(spark, tmp_path):
    logs, kept = tmp_path / "logs", tmp_path / "store"
    logs.mkdir()
    (logs / "a.log").write_text(PLAIN), (logs / "b.log").write_text(LATE)
    store = LineStore(spark, f"file://{kept}")
    t = Tools(spark, f"file://{logs}", now=NOW, store=store)
    assert store.refresh(list_files(spark, t.log_dir)) == ["a.log", "b.log"] and store.refresh(list_files(spark, t.log_dir)) == []
    with (logs / "a.log").open("a") as f:
        f.write("2026-07-17T11:59:00Z FATAL the end\n")
    os.utime(logs / "a.log", (2_000_000_000, 2_000_000_000))
    ask = {"file": "a.log", "level": "fatal", "since": "2026-07-17T11:30:00Z"}
    assert "the end" in t.call("get_errors", ask)
    (logs / "b.log").unlink()
    assert store.refresh(list_files(spark, t.log_dir)) == ["a.log"]
    assert "the end" in t.call("get_errors", ask) and set(store.manifest()) == {"a.log"}
    store.watch(t.log_dir, 0.1)
    store.close()


def test_search_stops_at_one_match_too_many(spark, tmp_path):
    (tmp_path / "c.log").write_text(ENTRIES)
    t = Tools(spark, f"file://{tmp_path}", now=NOW)
    for split in (1 << 20, 500):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            got, _ = t.search_logs("job", "c.log", max_results=30, field="message")
            assert [m["line_number"] for m in got["matches"]] == list(range(1, 31)) and got["omissions"] == {"matches": {"capped_at": 30}}
            got, _ = t.search_logs("job 11\\d", "c.log", max_results=30, field="message")
            assert got["returned"] == 10 and "omissions" not in got
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_cursors_of_files(spark, tmp_path):
    """What the poll of a file says is what the poll of its bytes says."""
    path, token = tmp_path / "g.log", None
    for text in ("", "one\ntwo", "one\ntwo more\n", "one\ntwo more\n" + "x" * 50 + "\n" * 3, "new\n", "long " * 30 + "\n" + "line\n" * (COUNT_HERE // 5 + 10) + "rest"):
        path.write_text(text)
        got, want = poll(spark, "g.log", f"file://{path}", token), poll_bytes("g.log", text.encode(), token)
        assert got.cursor == want.cursor and got.reset == want.reset
        assert not want.lines or got.first == want.lines[0][0]
        token = got.cursor
    assert Cursor.decode(token).lines == COUNT_HERE // 5 + 11


def test_sections_of_many_spans(spark):
    from quarrylog.functions.timeargs import Around

    rng = __import__("random").Random(3)
    at = sorted(rng.choice([rng.randrange(0, 900_000), 21_600 * rng.randrange(40) + rng.randrange(-3, 4) + 100]) for _ in range(400))
    for around in (Around(0, 0), Around(5, 0), Around(300, 60), Around(20_000, 9_000)):
        want, width = [], around.before + around.after
        for t in at:
            if want and t - want[-1][1] <= width:
                want[-1][1], want[-1][2] = t, want[-1][2] + 1
            else:
                want.append([t, t, 1])
        df = spark.createDataFrame([(t,) for t in at], "t long").selectExpr("timestamp_seconds(t) AS ts")
        got = sorted((int(r.f), int(r.t), r.anchor_count) for r in groups.sections(df, around).selectExpr("unix_seconds(from_ts) AS f", "unix_seconds(to_ts) AS t", "anchor_count").collect())
        assert got == [(a - around.before, z + around.after, n) for a, z, n in want]
