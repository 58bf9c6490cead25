import json
from datetime import datetime, timedelta, timezone

import pytest

from quarrylog.service.rpc import handle
from quarrylog.service.toon import respond
from quarrylog.service.tools import Tools

NOW = datetime(2026, 7, 17, 10, 30, tzinfo=timezone.utc)
PLAIN = """2026-01-15 10:30:00 INFO Request handled
2026-01-15 10:30:01 WARN Slow query detected
2026-01-15 10:30:02 ERROR Connection failed
2026-01-15 10:30:03 FATAL Out of memory
2026-01-15 10:30:04 INFO Health check OK
2026-01-15 10:30:05 ERROR Timeout on upstream service
2026-01-15 10:30:06 WARN deprecated API call
"""
APP = """2026-07-17T10:03:00Z INFO request 1 handled
2026-07-17T10:05:00Z INFO request 2 handled
2026-07-17T10:05:30Z ERROR db timeout id=9
2026-07-17T10:10:00Z INFO cron sweep 7 done
2026-07-17T10:16:00Z INFO request 3 handled
2026-07-17T10:20:00Z ERROR redis connection refused conn=ab12cd34ef
2026-07-17T10:21:00Z ERROR redis connection refused conn=99887766aa
2026-07-17T10:24:00Z ERROR redis connection refused conn=deadbeef11
"""
WEB = """2026-07-17T10:04:00Z INFO GET /health 200
2026-07-17T10:22:00Z INFO GET /health 200
2026-07-17T10:23:00Z INFO GET /health 200
"""


@pytest.fixture
def make(spark, tmp_path):
    def tools(files, **options):
        for name, text in files.items():
            (tmp_path / name).write_text(text)
        return Tools(spark, f"file://{tmp_path}", now=NOW, **options)

    return tools


def test_levels_of_a_plain_file(make):
    t = make({"app.log": PLAIN})
    assert [t.get_errors("app.log", level=x)[0]["error_count"] for x in ("warn", "error", "fatal", "info")] == [5, 3, 1, 7]
    got, text = t.get_errors("app.log", exclude="Slow", lines=2)
    assert got["error_count"] == 2 and got["omissions"] == {"lines": {"omitted": 2, "showing": "newest 2"}}
    assert [m["line_number"] for m in got["matches"]] == [6, 7] and text.startswith("# ")
    stats = t.log_stats("app.log")[0]
    assert (stats["line_count"], stats["error_count"], stats["warn_count"], stats["fatal_count"], stats["ts_parse_ratio"]) == (7, 2, 2, 1, 1.0)
    with pytest.raises(ValueError):
        t.get_errors("app.log", level="loud")
    with pytest.raises(ValueError):
        t.get_errors("app.log", exclude="(")


def test_summary_of_an_incident(make):
    t = make({"app.log": APP, "web.log": WEB})
    got, text = t.summarize(since="2026-07-17T10:15:00Z", until="2026-07-17T10:30:00Z")
    (new,) = got["new_templates"]
    assert (new["count"], new["instances_seen"], new["first_ts"]) == (3, "1/2", "2026-07-17T10:20:00Z") and new["sample"].endswith("conn=ab12cd34ef")
    assert new["template"] == "<TS> ERROR redis connection refused conn=<HEX>"
    assert {g["template"] for g in got["gone_templates"]} == {"<TS> ERROR db timeout id=<N>", "<TS> INFO cron sweep <N> done"}
    rate = got["error_rate"]
    assert (rate["window_errors"], rate["baseline_errors"], rate["window_per_min"], rate["baseline_per_min"], rate["delta_per_min"]) == (3, 1, 0.2, 0.07, 0.13)
    assert {v["source"]: (v["window_lines"], v["baseline_lines"]) for v in got["volume"]} == {"app.log": (4, 4), "web.log": (2, 1)}
    assert (got["files_scanned"], got["sources_seen"], got["unparsed_ts"]) == (2, 2, 0) and "omissions" not in got and "== new templates (1) ==" in text
    short = t.summarize(window="15m", baseline="5m")[0]
    assert [g["template"] for g in short["gone_templates"]] == ["<TS> INFO cron sweep <N> done"]


def test_lines_without_a_stamp_pass(make):
    rel = lambda m: (NOW - timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%SZ")
    t = make({"mixed.log": f"{rel(120)} ERROR old\n{rel(10)} ERROR recent failure\nERROR no stamp\njust text\n{rel(5)} INFO fine\n", "bare.log": "a\nb\nc\nd\n"})
    got = t.get_errors("mixed.log", since="1h")[0]
    assert got["error_count"] == 2 and got["unparsed_ts"] == 2
    got = t.tail_log("bare.log", since="5m")[0]
    assert got["lines"] == 4 and got["unparsed_ts"] == 4
    assert t.summarize(window="15m", file="bare.log")[0]["unparsed_ts"] == 4
    with pytest.raises(ValueError):
        t.get_errors("mixed.log", since="whenever")


GATEWAY = [
    {"sessionId": "abc-123", "traceId": "t1", "message": "in", "timestamp": "2026-03-20T14:00:00.000Z", "severity": "INFO"},
    {"sessionId": "abc-123", "traceId": "t2", "message": "out", "timestamp": "2026-03-20T14:00:02.000Z", "severity": "ERROR"},
    {"sessionId": "xyz-999", "nested": {"requestId": "abc-123"}, "message": "other", "timestamp": "2026-03-20T14:00:01.000Z", "severity": "WARNING"},
    {"sessionId": "xyz-999", "message": "none", "timestamp": "2026-03-20T14:00:05.000Z", "severity": "INFO"},
]
API = """2026-03-20 14:00:00.500 INFO sessionId=abc-123 start
2026-03-20 14:00:03 ERROR sessionId: abc-123 failed
no stamp sessionId=abc-123
2026-03-20 14:00:04 INFO sessionId=def-456 ok
2026-03-20 14:00:04 INFO other
"""


def test_correlation_by_id(make):
    t = make({"gateway.log": "".join(json.dumps(x) + "\n" for x in GATEWAY) + "{}\nnot json\n", "api.log": API})
    got = t.correlate(value="abc-123")[0]
    assert got["total_matches"] == 6 and got["files_matched"] == ["api.log", "gateway.log"] and got["unparsed_ts"] == 1
    stamps = [e["timestamp"] for e in got["timeline"]]
    assert stamps[:-1] == sorted(stamps[:-1]) and stamps[-1] is None
    by_field = t.correlate(value="abc-123", field="sessionId")[0]
    assert by_field["total_matches"] == 5
    assert t.correlate(value="abc-123", field="traceId")[0]["total_matches"] == 0
    assert t.correlate(value="abc-123", max_results=2)[0]["omissions"]["matches"]["omitted"] == 4
    ids = t.trace_ids("sessionId")[0]["entries"]
    assert [(x["value"], x["count"]) for x in ids] == [("abc-123", 5), ("xyz-999", 2), ("def-456", 1)]
    with pytest.raises(ValueError):
        t.correlate()


def test_correlation_around_an_anchor(make):
    t = make({
        "web.log": "[src:w] 2026-03-20T10:00:00Z boot loop detected\n[src:w] 2026-03-20T10:00:04Z x\n[src:w] 2026-03-20T10:05:00Z boot loop detected\n[src:w] boot loop detected unstamped\n",
        "db.log": "2026-03-20 09:59:57 near\n2026-03-20 10:00:09 later\n2026-03-20 11:00:00 far\n",
    })
    got, text = t.correlate(anchor={"pattern": "boot loop detected", "window": "±5s"})
    assert got["total_anchors"] == 3 and got["anchors_unparsed_ts"] == 1 and len(got["sections"]) == 2
    assert {e["file"] for e in got["sections"][0]["entries"]} == {"web.log", "db.log"} and "== window 2026-03-20T09:59:55Z .. 2026-03-20T10:00:05Z (1 anchor) ==" in text
    assert [s["anchor_count"] for s in t.correlate(anchor={"pattern": "boot loop", "window": "±30m"})[0]["sections"]] == [2]
    after = t.correlate(anchor={"pattern": "boot loop", "before": "0s", "after": "10s"})[0]
    assert after["window"] == "-0s/+10s" and [e["content"][-5:] for e in after["sections"][0]["entries"]][-1] == "later"
    exact = t.correlate(anchor={"pattern": "boot loop", "before": "0s", "after": "0s"})[0]
    assert [(s["from"], s["to"]) for s in exact["sections"]] == [("2026-03-20T10:00:00Z",) * 2, ("2026-03-20T10:05:00Z",) * 2]
    one = t.correlate(anchor={"pattern": "boot loop", "window": "±5s"}, max_sections=1)[0]
    assert one["omissions"]["sections"] == {"omitted": 1, "showing": "first 1 by time"}
    assert t.correlate(anchor={"pattern": "absent"})[0]["sections"] == []


def test_search(make):
    t = make({"app.log": "".join(f"ERROR failure number {k}\n" for k in range(30)), "gw.log": "".join(json.dumps(x) + "\n" for x in GATEWAY)})
    got = t.search_logs("FAILURE", "app.log", max_results=10)[0]
    assert len(got["matches"]) == 10 and got["omissions"] == {"matches": {"omitted": 20, "showing": "first 10"}}
    near = t.search_logs("number 7", "app.log", context=2)[0]["matches"]
    assert near[0]["context"].split("\n") == [f"ERROR failure number {k}" for k in (5, 6, 8, 9)]
    assert [m["line_number"] for m in t.search_logs("^xyz", "gw.log", field="sessionId")[0]["matches"]] == [3, 4]
    assert [m["line_number"] for m in t.search_logs("xyz", "gw.log")[0]["matches"]] == [3, 4]
    with pytest.raises(ValueError):
        t.search_logs("(", "app.log")
    with pytest.raises(ValueError):
        t.search_logs("x", "app.log", cursor="c", field="f")


def test_rollup(make):
    files = {
        f"web-{k}.log": "".join(f"[src:web-{k}] 2026-07-17T18:0{m}:0{k}Z proxy[9af{k}c2d871] upstream 10.0.0.{k} timed out after {m}0s\n" for m in range(1, 3)) for k in (1, 2)
    }
    t = make(files | {"web-2.1.log": "[src:web-2] 2026-07-17T17:00:00Z proxy[ab23456789] upstream 10.1.1.1 timed out after 5s\n", "web-3.log": "[src:web-3] 2026-07-17T17:00:00Z fine\n"})
    (row,) = t.search_logs("timed out", rollup=True)[0]["entries"]
    assert row["template"] == "<TS> proxy[<HEX>] upstream <IP> timed out after <N>s" and (row["count"], row["instances_seen"]) == (5, "2/3")
    assert (row["first_ts"], row["last_ts"]) == ("2026-07-17T17:00:00Z", "2026-07-17T18:02:02Z")
    assert t.all_errors(rollup=True)[0]["total_matches"] == 0
    errors = t.all_errors(level="info")
    assert errors[1] == "No errors found in any log file."


def test_aggregate(make):
    rows = [{"severity": "info", "message": f"request {k}", "fields": {"gated": True} if k in (137, 342) else {"id": k % 3}} for k in range(1, 501)]
    t = make({"app.log": "".join(json.dumps(r) + "\n" for r in rows), "values.log": "\n".join(json.dumps({"v": v}) for v in (42, True, None, {"deep": 1}, 42)) + "\n", "arr.log": json.dumps([{"v": 1}, {"v": 2}])})
    got = t.aggregate("fields.gated", "exists", "app.log")[0]
    assert (got["lines_with"], got["lines_without"], got["non_json"]) == (2, 498, 0) and "request 137" in got["sample"]
    assert t.aggregate("fields.gated", "count", "app.log", pattern="request 1")[0]["occurrences"] == 1
    got = t.aggregate("v", "values", "values.log")[0]
    assert [(e["value"], e["count"]) for e in got["entries"]] == [("42", 2), ("null", 1), ("true", 1), ('{"deep":1}', 1)]
    assert t.aggregate("v", "values", "values.log", max_values=1)[0]["omissions"]["values"]["omitted"] == 3
    assert t.aggregate("v", "count", "arr.log")[0]["occurrences"] == 2
    with pytest.raises(ValueError):
        t.aggregate("v", "sum")


def test_time_range_and_tail(make):
    t = make({"a.log": "2026-03-20T10:00:00Z a\n2026-03-20T12:30:00Z b\n2026-03-20T14:00:00Z c\n"})
    got = t.time_range("a.log")[0]
    assert (got["earliest"], got["latest"], got["span"], got["line_count"]) == ("2026-03-20T10:00:00Z", "2026-03-20T14:00:00Z", "4h", 3)
    first = t.tail_log("a.log", 2)[0]
    assert first["content"].split("\n")[-1].endswith(" c") and first["omissions"]["lines"]["omitted"] == 1
    again = t.tail_log("a.log", cursor=first["cursor"])[0]
    assert again["lines"] == 0
    make({"a.log": "2026-03-20T10:00:00Z a\n2026-03-20T12:30:00Z b\n2026-03-20T14:00:00Z c\nnew\n"})
    assert t.tail_log("a.log", cursor=first["cursor"])[0]["content"] == "new"
    make({"a.log": "other\n"})
    reset = t.tail_log("a.log", cursor=first["cursor"])[0]
    assert reset["cursor_reset"] and reset["content"] == "other"


def test_listing_and_names(make, tmp_path):
    t = make({"b.log": "x\n", "a.log": "y\n", "c.txt": "z\n"}, status={"b": {"status": "running"}})
    got = t.list_logs()[0]["entries"]
    assert [e["name"] for e in got] == ["a.log", "b.log"] and got[1]["live"] and got[1]["status"] == "running" and not got[0]["live"]
    for bad in ("../a.log", "x/y.log", ""):
        with pytest.raises(ValueError):
            t.get_errors(bad) if bad else t.log_stats(bad)
    with pytest.raises(FileNotFoundError):
        t.get_errors("none.log")
    small = make({}, max_mb=0)
    assert {s["file"] for s in small.summarize(window="1h")[0]["omissions"]["skipped_files"]} == {"a.log", "b.log"}
    with pytest.raises(ValueError):
        small.get_errors("a.log")


def test_sync(make, tmp_path):
    src = tmp_path / "bucket" / "deep"
    src.mkdir(parents=True)
    (src / "api-1.log").write_text("1\n")
    (src / "web-1.log").write_text("2\n")
    t = make({})
    got = t.sync_logs(f"file://{tmp_path}/bucket", prefix="api")[0]
    assert (got["listed"], got["copied"]) == (2, ["api-1.log"]) and (tmp_path / "api-1.log").read_text() == "1\n"
    assert t.sync_logs(f"file://{tmp_path}/bucket", prefix="api")[0]["copied"] == []
    assert t.sync_logs(f"file://{tmp_path}/bucket", since="2999-01-01T00:00:00Z")[0]["selected"] == 0
    with pytest.raises(ValueError):
        t.sync_logs("ftp://x")


def test_rpc(make):
    t = make({"a.log": "ERROR x\n"})
    ask = lambda **x: handle(t, json.dumps({"jsonrpc": "2.0", "id": 1} | x))
    assert ask(method="initialize")["result"]["serverInfo"]["name"] == "quarrylog"
    assert len(ask(method="tools/list")["result"]["tools"]) == 12
    assert "ERROR x" in ask(method="tools/call", params={"name": "get_errors", "arguments": {"file": "a.log"}})["result"]["content"][0]["text"]
    assert ask(method="tools/call", params={"name": "nope"})["error"]["code"] == -32602
    assert ask(method="tools/call", params={"name": "get_errors", "arguments": {"file": "a.log", "x": 1}})["result"]["isError"]
    assert ask(method="what")["error"]["code"] == -32601 and handle(t, "{")["error"]["code"] == -32700
    assert handle(t, '{"method": "note"}') is None


def test_tables():
    assert respond({"matches": [{"b": "x|y\nz", "a": None}, {"c": 1}], "n": 2}) == '# {"n":2}\n[a|b|c]\n|x\\|y\\nz|\n||1'
    assert respond({"matches": []}) == '{"matches":[]}' and respond({"entries": [{"a": 1}]}, "json") == '{"entries":[{"a":1}]}'


def test_sections_merge_when_they_touch(spark):
    from quarrylog.functions.timeargs import Around
    from quarrylog.operators.groups import sections
    from quarrylog.session import configure

    configure(spark)
    made = lambda *s: spark.createDataFrame([(datetime(2026, 1, 1, 10, 0, x, tzinfo=timezone.utc),) for x in s] + [(None,)], "ts timestamp")
    got = lambda df, a: [(r.f, r.t, r.anchor_count) for r in sections(df, a).selectExpr("cast(second(from_ts) as int) f", "cast(second(to_ts) as int) t", "anchor_count", "from_ts").orderBy("from_ts").collect()]
    assert got(made(0, 8, 12), Around(10, 10)) == [(50, 22, 3)]
    assert got(made(0, 20), Around(10, 10)) == [(50, 30, 2)] and got(made(0, 21), Around(10, 10)) == [(50, 10, 1), (11, 31, 1)]
    assert got(made(0, 0, 5), Around(1, 1)) == [(59, 1, 2), (4, 6, 1)] and got(made(), Around()) == []
