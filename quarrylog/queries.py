"""Queries over the driver's tables, each with the same result in SQL.

``events`` is read as log lines of three files and as JSON entries.  Every
fiftieth line has no timestamp, so that the rules about such lines matter.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.template import template
from .functions.text import human_bytes, human_span, literal
from .functions.timeargs import Around, around, diff_bounds, instant
from .functions.timestamps import Declared, declared_time, epoch_millis_text, line_time, source_of, strip_ansi, strip_source
from .operators import fields, groups, scan
from .plans.lines import enrich
from .plans.zone_map import store, stored
from .session import configure
from .shared import fresh
from .sources.listings import parse_listing
from .streaming.live import window_counts

NOW = datetime(2024, 1, 15, 12, tzinfo=timezone.utc)
SINCE = NOW - timedelta(days=2)
MTIME = datetime(2024, 1, 31, tzinfo=timezone.utc)
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(configure(spark), sf_dir)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def dealt(df: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores is dealt out: parsing costs far more than moving its rows.  Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dealt(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props"))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").when(F.col("event_type") == "click", "DEBUG").otherwise("INFO")
    k = F.get_json_object("props", "$.k")
    service = F.col("user_id") % 3
    return e.select(F.concat(F.lit("svc-"), service.cast("string"), F.lit(".log")).alias("file"), service.cast("int").alias("file_ord"), (F.col("event_id") + 1).alias("line_number"), F.date_format("ts", STAMP).alias("stamp"), level.alias("name"), "event_type", "user_id", k.alias("k"), (F.col("event_id") % 50 == 7).alias("bare"), F.lit(MTIME).alias("mtime"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat("name", F.lit(" "), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" k="), "k")
    content = F.when(F.col("bare"), body).otherwise(F.concat("stamp", F.lit(" "), body))
    return enrich(events(spark, sf_dir).select("file", "file_ord", "line_number", content.alias("content"), F.lit("plain").alias("format"), "mtime"))


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("name"))
    fields_ = F.struct(F.lower("name").alias("severity"), F.concat("event_type", F.lit(" by u-"), F.col("user_id").cast("string")).alias("message"), F.when(~F.col("bare"), F.col("stamp")).alias("timestamp"), user.alias("user"), F.when(F.col("event_type") == "purchase", F.col("k").cast("int")).alias("k"))
    return enrich(events(spark, sf_dir).select("file", "file_ord", "line_number", F.to_json(fields_).alias("content"), F.lit("json").alias("format"), "mtime"))


def placed(rows: DataFrame) -> DataFrame:
    """An operator's limited rows with their places: sorted rows with a limit come as one partition, in order."""
    return rows.withColumn("place", F.monotonically_increasing_id() + 1)


def iso(c: str) -> F.Column:
    return F.date_format(c, STAMP).alias(c)


E_ = r"""
WITH e AS (
  SELECT 'svc-' || (user_id % 3) || '.log' AS file, user_id % 3 AS file_ord, event_id + 1 AS line_number,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END AS name,
         CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'click' THEN 1 ELSE 2 END AS level,
         event_type, user_id, json_extract_string(props, '$.k') AS k, ts AS moment, event_id % 50 = 7 AS bare,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp
  FROM events),
l AS (
  SELECT *, CASE WHEN bare THEN NULL ELSE moment END AS ts, CASE WHEN bare THEN NULL ELSE stamp END AS ts_text,
         name || ' ' || event_type || ' user=' || user_id || ' k=' || k AS body,
         CASE WHEN bare THEN '' ELSE stamp || ' ' END || name || ' ' || event_type || ' user=' || user_id || ' k=' || k AS content,
         event_type || ' by u-' || user_id AS message
  FROM e)
"""
T_SINCE = "TIMESTAMP '2024-01-13 12:00:00'"
T_NOW = "TIMESTAMP '2024-01-15 12:00:00'"


@query(E_ + "SELECT file, count(*) AS line_count, CAST(sum(length(content) + 1) AS BIGINT) AS size_bytes FROM l GROUP BY file")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).groupBy("file").agg(F.count("*").alias("line_count"), F.sum(F.length("content") + 1).alias("size_bytes"))


RATIO = "SELECT file, count(*) AS ts_sample_size, round(count(ts) / count(*), 3) AS ts_parse_ratio FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_number) AS n FROM l) WHERE n <= 1000 GROUP BY file"
STATS = E_ + f""", c AS (
  SELECT file, count(*) AS line_count, count(*) FILTER (WHERE level = 4) AS error_count, count(*) FILTER (WHERE level = 3) AS warn_count,
         count(*) FILTER (WHERE level = 5) AS fatal_count FROM l GROUP BY file), r AS ({RATIO})
SELECT c.*, r.ts_sample_size, r.ts_parse_ratio FROM c JOIN r ON c.file = r.file"""


@query(STATS)
def log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.stats(event_lines(spark, sf_dir))


@query(STATS)
def log_stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.stats(event_entries(spark, sf_dir))


@query(E_ + """, s AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_number) AS a, row_number() OVER (PARTITION BY file ORDER BY line_number DESC) AS z FROM l),
g AS (SELECT file, min(ts) AS mn, max(ts) AS mx, count(*) AS ts_sample_size, round(count(ts) / count(*), 3) AS ts_parse_ratio
      FROM (SELECT DISTINCT file, content, ts FROM s WHERE a <= 10 OR z <= 10) GROUP BY file),
d AS (SELECT *, CAST(floor(epoch(mx) - epoch(mn)) AS BIGINT) AS sec FROM g)
SELECT d.file, (SELECT count(*) FROM l WHERE l.file = d.file) AS line_count, strftime(mn, '%Y-%m-%dT%H:%M:%S.%fZ') AS earliest,
       strftime(mx, '%Y-%m-%dT%H:%M:%S.%fZ') AS latest, ts_sample_size, ts_parse_ratio,
       concat_ws(' ', CASE WHEN sec // 86400 > 0 THEN (sec // 86400) || 'd' END, CASE WHEN sec // 3600 % 24 > 0 THEN (sec // 3600 % 24) || 'h' END,
                 CASE WHEN sec // 60 % 60 > 0 THEN (sec // 60 % 60) || 'm' END, CASE WHEN sec % 60 > 0 THEN (sec % 60) || 's' END) AS span
FROM d""")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.time_range(event_lines(spark, sf_dir)).withColumn("earliest", iso("earliest")).withColumn("latest", iso("latest"))


def newest_sql(keep: str, limit: int, columns: str) -> str:
    return E_ + f", n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_number DESC) AS n FROM l WHERE {keep}) SELECT {columns} FROM n WHERE n <= {limit}"


@query(newest_sql("true", 50, "file, line_number, content"))
def tail_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.tail(event_lines(spark, sf_dir), 50).rows


@query(newest_sql(f"ts IS NULL OR ts >= {T_SINCE}", 40, "file, line_number, content"))
def tail_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.tail(event_lines(spark, sf_dir), 40, SINCE).rows


SEARCH = "error.*k=[0-4]"


@query(E_ + f"SELECT file, line_number, content AS text FROM l WHERE regexp_matches(content, '(?i){SEARCH}') AND (ts IS NULL OR ts >= {T_SINCE}) ORDER BY file_ord, line_number LIMIT 60")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.search(event_lines(spark, sf_dir), SEARCH, 60, since=SINCE).rows


@query(E_ + f"SELECT count(*) FILTER (WHERE regexp_matches(content, '(?i){SEARCH}') AND (ts IS NULL OR ts >= {T_SINCE})) AS total, count(*) FILTER (WHERE ts IS NULL) AS unparsed_ts FROM l")
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.search(event_lines(spark, sf_dir), SEARCH, 60, since=SINCE).facts


@query(E_ + """, o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_number) AS o FROM l),
h AS (SELECT file, line_number, o, content AS text FROM o WHERE regexp_matches(content, 'user=7 ') ORDER BY file_ord, line_number LIMIT 20)
SELECT h.file, h.line_number, h.text,
       coalesce((SELECT string_agg(c.content, chr(10) ORDER BY c.o) FROM o c WHERE c.file = h.file AND c.line_number BETWEEN h.line_number - 6 AND h.line_number + 6 AND c.o <> h.o), '') AS context
FROM h""")
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    found = scan.with_context(lines, scan.search(lines, "user=7 ", 20).rows, 6)
    return found.withColumn("context", F.coalesce("context", F.lit("")))


@query(E_ + "SELECT file, line_number, lower(name) AS severity, coalesce(ts_text, '') AS ts_text, message AS text FROM l WHERE regexp_matches('u-' || user_id, '(?i)^U-1[0-9]$') ORDER BY file_ord, line_number LIMIT 50")
def search_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.search(event_entries(spark, sf_dir), "^U-1[0-9]$", 50, field="user.name").rows


ERROR_COLUMNS = "file, line_number, lower(name) AS severity, coalesce(ts_text, '') AS ts_text, content AS text"


@query(newest_sql("level >= 4", 100, ERROR_COLUMNS))
def get_errors_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.errors(event_lines(spark, sf_dir), "error", 100).rows


@query(newest_sql(f"level >= 3 AND NOT regexp_matches(content, 'k=[5-9]$') AND (ts IS NULL OR ts BETWEEN {T_SINCE} AND {T_NOW})", 80, ERROR_COLUMNS))
def get_errors_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.errors(event_lines(spark, sf_dir), "warn", 80, "k=[5-9]$", SINCE, NOW).rows


@query(newest_sql("level >= 3", 30, "file, line_number, lower(name) AS severity, coalesce(ts_text, '') AS ts_text, message AS text"))
def get_errors_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.errors(event_entries(spark, sf_dir), "warn", 30).rows


@query(E_ + "SELECT file, least(count(*) FILTER (WHERE level >= 3), 20) AS error_count, greatest(count(*) FILTER (WHERE level >= 3) - 20, 0) AS omitted, CAST(NULL AS BIGINT) AS unparsed_ts FROM l GROUP BY file")
def all_errors_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.errors(event_lines(spark, sf_dir), "warn", 20).facts


@query(newest_sql("level >= 3", 20, ERROR_COLUMNS))
def all_errors_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.errors(event_lines(spark, sf_dir), "warn", 20).rows


TEMPLATE = "regexp_replace(regexp_replace(content, '^[0-9-]+T[0-9:.]+Z', '<TS>'), '=[0-9]+', '=<N>', 'g')"


@query(E_ + f""", u AS (SELECT count(DISTINCT file) AS n FROM l)
SELECT {TEMPLATE} AS template, count(*) AS count, count(DISTINCT file) || '/' || (SELECT n FROM u) AS instances_seen,
       strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS first_ts, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_ts,
       first(content ORDER BY file_ord, line_number) AS sample
FROM l WHERE level >= 3 GROUP BY ALL""")
def rollup_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    got = groups.rollup(lines.where(scan.error_hits("warn", None)), lines).rows
    return got.withColumn("first_ts", iso("first_ts")).withColumn("last_ts", iso("last_ts"))


@query(E_ + "SELECT count(*) FILTER (WHERE event_type = 'purchase') AS lines_with, count(*) FILTER (WHERE event_type <> 'purchase') AS lines_without, CAST(0 AS BIGINT) AS non_json, (SELECT line_number FROM l WHERE event_type = 'purchase' ORDER BY file_ord, line_number LIMIT 1) AS sample_line FROM l")
def aggregate_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.exists(event_entries(spark, sf_dir), "k").drop("sample", "sample_file")


@query(E_ + f"SELECT k AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, k) AS place FROM l WHERE event_type = 'purchase' AND (ts IS NULL OR ts >= {T_SINCE}) GROUP BY k ORDER BY count DESC, value LIMIT 12")
def aggregate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(fields.values(event_entries(spark, sf_dir), "k", 12, since=SINCE).rows)


@query(E_ + "SELECT count(*) AS occurrences, CAST(0 AS BIGINT) AS lines_without, CAST(0 AS BIGINT) AS non_json FROM l WHERE regexp_matches(content, '(?i)error|info')")
def aggregate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.count(event_entries(spark, sf_dir), "user.id", pattern='"severity":"(error|info)"')


BOUNDS = dict(window="2d", until="2024-01-15T12:00:00Z", baseline="1d", now=NOW)
RANGES = E_ + f""", r AS (
  SELECT *, {TEMPLATE.replace('content', 'varied')} AS template, ts IS NULL OR ts BETWEEN {T_SINCE} AND {T_NOW} AS w,
         ts IS NULL OR (ts >= {T_SINCE} - INTERVAL 1 DAY AND ts < {T_SINCE}) AS b
  FROM (SELECT *, regexp_replace(content, 'k=([0-9]+)$', 'day' || CASE WHEN ts IS NULL THEN 'x' ELSE chr(CAST(97 + day(ts) % 20 AS INTEGER)) END || ' k=\\1') AS varied FROM l))
"""


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines with a letter of the day in them, so that templates come and go."""
    day = F.coalesce(F.chr(F.lit(97) + F.dayofmonth("ts") % 20), F.lit("x"))
    lines = event_lines(spark, sf_dir)
    return lines.withColumn("text", F.regexp_replace("content", F.lit("k=([0-9]+)$"), F.concat(F.lit("day"), day, F.lit(" k=$1"))))


@query(RANGES + """SELECT template, CAST(count(*) FILTER (WHERE w) AS BIGINT) AS count, count(DISTINCT file) || '/' || (SELECT count(DISTINCT file) FROM r WHERE w OR b) AS instances_seen,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS first_ts, first(varied ORDER BY file_ord, line_number) AS sample
FROM r WHERE w OR b GROUP BY template HAVING count(*) FILTER (WHERE w) > 0 AND count(*) FILTER (WHERE b) = 0 ORDER BY count DESC, template LIMIT 20""")
def summarize_templates_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.summarize(_varied(spark, sf_dir), diff_bounds(**BOUNDS)).new.withColumn("first_ts", iso("first_ts"))


@query(RANGES + """SELECT template, count(*) FILTER (WHERE b) AS baseline_count, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_ts
FROM r WHERE w OR b GROUP BY template HAVING count(*) FILTER (WHERE b) > 0 AND count(*) FILTER (WHERE w) = 0 ORDER BY baseline_count DESC, template LIMIT 20""")
def summarize_templates_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.summarize(_varied(spark, sf_dir), diff_bounds(**BOUNDS)).gone.withColumn("last_ts", iso("last_ts"))


@query(RANGES + """, t AS (SELECT CAST(count(*) FILTER (WHERE w AND level >= 4) AS BIGINT) AS window_errors, CAST(count(*) FILTER (WHERE b AND level >= 4) AS BIGINT) AS baseline_errors FROM r)
SELECT *, round(window_errors / 2880.0, 2) AS window_per_min, round(baseline_errors / 1440.0, 2) AS baseline_per_min, round(round(window_errors / 2880.0, 2) - round(baseline_errors / 1440.0, 2), 2) AS delta_per_min FROM t""")
def summarize_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.summarize(_varied(spark, sf_dir), diff_bounds(**BOUNDS)).error_rate


@query(RANGES + """, t AS (SELECT file AS source, CAST(count(*) FILTER (WHERE w) AS BIGINT) AS window_lines, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS baseline_lines FROM r WHERE w OR b GROUP BY file)
SELECT *, round(window_lines / 2880.0, 2) AS window_per_min, round(baseline_lines / 1440.0, 2) AS baseline_per_min, round(round(window_lines / 2880.0, 2) - round(baseline_lines / 1440.0, 2), 2) AS delta_per_min FROM t""")
def summarize_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.summarize(_varied(spark, sf_dir), diff_bounds(**BOUNDS)).volume


@query(E_ + "SELECT file, line_number, ts_text AS timestamp, lower(name) AS severity, content, row_number() OVER (ORDER BY ts_text ASC NULLS LAST, file_ord, line_number) AS place FROM l WHERE contains(content, 'user=12') ORDER BY ts_text ASC NULLS LAST, file_ord, line_number LIMIT 200")
def correlate_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(groups.correlate(event_lines(spark, sf_dir), "user=12").rows)


@query(E_ + "SELECT file, line_number, ts_text AS timestamp, lower(name) AS severity, message AS content, row_number() OVER (ORDER BY ts_text ASC NULLS LAST, file_ord, line_number) AS place FROM l WHERE user_id = 12 ORDER BY ts_text ASC NULLS LAST, file_ord, line_number LIMIT 200")
def correlate_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(groups.correlate(event_entries(spark, sf_dir), "u-12", "user.name").rows)


@query(E_ + "SELECT file, line_number, ts_text AS timestamp, lower(name) AS severity, message AS content, row_number() OVER (ORDER BY ts_text ASC NULLS LAST, file_ord, line_number) AS place FROM l WHERE contains('u-' || user_id, 'u-3') ORDER BY ts_text ASC NULLS LAST, file_ord, line_number LIMIT 150")
def correlate_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(groups.correlate(event_entries(spark, sf_dir), "u-3", limit=150).rows)


@query(E_ + "SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count, min(ts_text) AS first_seen, max(ts_text) AS last_seen, row_number() OVER (ORDER BY count(*) DESC, CAST(user_id AS VARCHAR)) AS place FROM l GROUP BY user_id ORDER BY count DESC, value LIMIT 40")
def trace_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(groups.trace_ids(event_lines(spark, sf_dir), "user", 40).rows)


ISLANDS = E_ + """, a AS (SELECT ts, count(*) AS n FROM l WHERE user_id = 12 AND level = 4 AND ts IS NOT NULL GROUP BY ts),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM a),
k AS (SELECT *, sum(fresh) OVER (ORDER BY ts) AS k FROM g),
s AS (SELECT min(ts) - INTERVAL 4 HOUR AS f, max(ts) + INTERVAL 2 HOUR AS t, CAST(sum(n) AS BIGINT) AS anchor_count FROM k GROUP BY k)
"""
NEAR = Around(4 * 3600, 2 * 3600)
ANCHOR = "error error user=12 "


@query(ISLANDS + "SELECT strftime(f, '%Y-%m-%dT%H:%M:%S.%fZ') AS from_ts, strftime(t, '%Y-%m-%dT%H:%M:%S.%fZ') AS to_ts, anchor_count FROM s ORDER BY f LIMIT 5")
def anchor_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = groups.anchor(event_lines(spark, sf_dir), ANCHOR, NEAR).sections
    return got.withColumn("from_ts", iso("from_ts")).withColumn("to_ts", iso("to_ts"))


@query(ISLANDS + """, m AS (SELECT * FROM s ORDER BY f LIMIT 5)
SELECT strftime(f, '%Y-%m-%dT%H:%M:%S.%fZ') AS from_ts, file, line_number, ts_text AS timestamp, lower(name) AS severity, content, row_number() OVER (ORDER BY f, ts_text, file, line_number) AS place
FROM l JOIN m ON l.ts BETWEEN m.f AND m.t ORDER BY f, ts_text, file, line_number LIMIT 150""")
def anchor_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(groups.anchor(event_lines(spark, sf_dir), ANCHOR, NEAR, limit=150).entries).withColumn("from_ts", iso("from_ts")).drop("to_ts")


@query("""SELECT event_id, event_id % 8 AS kind, strftime(date_trunc(CASE WHEN event_id % 8 IN (0, 1) THEN 'microseconds' ELSE 'second' END, ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS at FROM events""")
def ts_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recognised and two declared formats, written and read back; time-only stamps by the day of their file."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") % 8).alias("kind"), F.col("ts").cast("timestamp").alias("t"))
    f = lambda p: F.date_format("t", p)
    k = F.col("kind")
    line = (
        F.when(k == 0, F.concat(f(STAMP), F.lit(" iso"))).when(k == 1, F.concat(F.lit("["), f("yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"), F.lit("] bracketed")))
        .when(k == 2, F.concat(F.lit("10.0.0.1 - - ["), f("dd/MMM/yyyy:HH:mm:ss xx"), F.lit('] "GET /"'))).when(k == 3, F.concat(f("yyyy-MM-dd HH:mm:ss"), F.lit(" text")))
        .when(k == 4, F.concat(f("MMM d HH:mm:ss"), F.lit(" host app"))).when(k == 5, F.concat(F.lit("[vite] "), f("h:mm:ss a"), F.lit(" hmr")))
        .when(k == 6, F.concat(F.lit("evt="), F.unix_seconds("t").cast("string"))).otherwise(F.concat(f("dd.MM.yyyy HH:mm:ss"), F.lit(" declared")))
    )
    rows = e.select("event_id", "kind", line.alias("content"), F.concat(F.lit("f"), k.cast("string"), F.lit(".log")).alias("file"), F.timestamp_micros(F.unix_micros("t") + 3_600_000_000).alias("mtime"))
    declared = declared_time([Declared("f6*", "epoch_s"), Declared("f7.log", "%d.%m.%Y %T")], F.col("file"), F.col("content"), F.col("mtime"))
    return rows.select("event_id", "kind", F.date_format(line_time(F.col("content"), F.col("mtime"), declared=declared)["at"], STAMP).alias("at"))


@query(E_ + "SELECT file, line_number, content FROM l WHERE line_number > (SELECT count(*) - 300 FROM events)")
def cursor_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after a place that an earlier poll reached."""
    reached = spark.read.parquet(f"{sf_dir}/events.parquet").count() - 300
    return event_lines(spark, sf_dir).where(F.col("line_number") > reached).select("file", "line_number", "content")


@query(E_ + f"SELECT file, line_number, content FROM l WHERE ts IS NULL OR ts BETWEEN {T_SINCE} AND {T_NOW}")
def zone_map_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded query over stored lines: the bounds reach Parquet's row groups."""
    return stored(spark, _stored(spark, sf_dir), SINCE, NOW).select("file", "line_number", "content")


_stores: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Where the events' lines are stored: written once for a session and a state of the table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    state = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    key = (spark.sparkContext.applicationId, sf_dir, state.getModificationTime(), state.getLen())
    if key not in _stores:
        path = fresh(spark, "lines")
        store(event_lines(spark, sf_dir), path)
        _stores[key] = path
    return _stores[key]


@query(E_ + """, p AS (
  SELECT file, unnest(['severity', 'message', 'user', 'user.id', 'user.name']) AS path FROM l
  UNION ALL SELECT file, 'timestamp' FROM l WHERE ts IS NOT NULL UNION ALL SELECT file, 'k' FROM l WHERE event_type = 'purchase')
SELECT file, path, false AS opaque, count(*) AS lines FROM p GROUP BY file, path""")
def field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.paths(event_entries(spark, sf_dir))


@query("""SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE regexp_matches(line, '(?i)(error|warn|info)')) AS n_marked
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def split_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.count_if(F.col("line").rlike("(?i)(error|warn|info)")).alias("n_marked"))


@query("""SELECT event_id, event_id % 3 AS kind, 'logs/a ' || event_id || '.log' AS key, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS modified FROM events WHERE event_id % 7 <> 0 AND event_id % 3 <> 0
UNION ALL SELECT event_id, 0, 'gs://b/' || event_id || '.log', strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') FROM events WHERE event_id % 7 <> 0 AND event_id % 3 = 0""")
def listing_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t, n = F.col("ts").cast("timestamp"), F.col("event_id").cast("string")
    bad = F.col("event_id") % 7 == 0
    iso_ = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made = {
        "gs": F.when(bad, F.lit("TOTAL: 2 objects, 10 bytes")).otherwise(F.concat(F.lit("  22  "), iso_, F.lit("  gs://b/"), n, F.lit(".log"))),
        "s3": F.when(bad, F.lit("        PRE logs/")).otherwise(F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("       22 logs/a "), n, F.lit(".log"))),
        "az": F.when(bad, F.lit("no tab here")).otherwise(F.concat(F.lit("logs/a "), n, F.lit(".log\t"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx"))),
    }
    out = None
    for kind, (name, c) in enumerate(made.items()):
        got = parse_listing(e.where(F.col("event_id") % 3 == kind).select(c.alias("value")), name)
        got = got.select(F.regexp_extract("key", r"(\d+)\.log$", 1).cast("long").alias("event_id"), F.lit(kind).cast("long").alias("kind"), "key", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))
        out = got if out is None else out.unionByName(got)
    return out


@query("""SELECT event_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN CAST(round(b / 1024.0, 1) AS VARCHAR) || ' KB' ELSE CAST(round(b / 1048576.0, 1) AS VARCHAR) || ' MB' END AS size,
  CASE WHEN s = 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd' END, CASE WHEN s // 3600 % 24 > 0 THEN (s // 3600 % 24) || 'h' END, CASE WHEN s // 60 % 60 > 0 THEN (s // 60 % 60) || 'm' END, CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END) END AS span
FROM (SELECT event_id, event_id * 37 AS b, event_id * 61 % 200000 AS s FROM events)""")
def human_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", human_bytes(F.col("event_id") * 37).alias("size"), human_span(F.col("event_id") * 61 % 200_000).alias("span"))


@query()
def templates_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of free text; SQL can't tell tokens apart, so a plain version in the tests does."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"[ \t\n\f\r]+", " ")).alias("text"))
    return c.select("conv_id", "turn", template(F.col("text")).alias("template"))


@query(E_ + "SELECT line_number, CASE WHEN line_number % 3 > 0 THEN 'svc-' || (user_id % 3) END AS source, body AS text FROM l")
def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours and source tags put on lines and taken off again."""
    lines = event_lines(spark, sf_dir).select("line_number", F.concat(F.lit("svc-"), F.col("file_ord").cast("string")).alias("name"), F.when(F.col("ts_line").isNull(), F.col("content")).otherwise(F.substring_index("content", "Z ", -1)).alias("body"))
    coloured = F.concat(F.lit("\x1b[1;31m"), F.substring("body", 1, 3), F.lit("\x1b[0m"), F.expr("substring(body, 4)"))
    tagged = F.when(F.col("line_number") % 3 > 0, F.concat(F.lit("[src:"), "name", F.lit("] "), coloured)).otherwise(coloured)
    return lines.select("line_number", tagged.alias("c")).select("line_number", source_of(F.col("c")).alias("source"), strip_ansi(strip_source(F.col("c"))).alias("text"))


@query("SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events")
def epoch_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer timestamps of entries as text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", epoch_millis_text(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"))


@query(f"""SELECT file, count(*) FILTER (WHERE contains(content, 'user=1 k=') OR contains(content, '(k.=')) AS lines FROM ({E_.strip()} SELECT * FROM l) GROUP BY file""")
def escaped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is sought as it is, whatever it means in a pattern."""
    wanted = F.col("content").rlike(literal("user=1 k=")) | F.col("content").rlike(literal("(k.="))
    return event_lines(spark, sf_dir).groupBy("file").agg(F.count_if(wanted).alias("lines"))


@query("""SELECT name, strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS at FROM (VALUES ('ago 90s', TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 90 SECOND), ('ago 2w', TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 14 DAY),
  ('iso', TIMESTAMP '2024-01-14 08:30:00'), ('window until', TIMESTAMP '2024-01-15 12:00:00'), ('window since', TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 6 HOUR),
  ('window baseline', TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 6 HOUR - INTERVAL 30 MINUTE), ('since baseline', TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 4 DAY), ('around', TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 10 SECOND)) t(name, moment)""")
def time_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What durations, times, windows and baselines in arguments come to."""
    w = diff_bounds(window="6h", baseline="30m", now=NOW)
    made = {
        "ago 90s": instant("90s", NOW), "ago 2w": instant("2w", NOW), "iso": instant("2024-01-14T10:30:00+02:00", NOW), "window until": w.until, "window since": w.since, "window baseline": w.baseline,
        "since baseline": diff_bounds(since="2d", now=NOW).baseline, "around": NOW - timedelta(seconds=around("±10s").before),
    }
    return spark.createDataFrame([(k, v.strftime("%Y-%m-%dT%H:%M:%SZ")) for k, v in made.items()], "name string, at string")


@query("""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%dT%H:%M:%SZ') AS start, event_type AS name, count(*) AS lines FROM events GROUP BY ALL""")
def live_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_counts(spark, sf_dir)
