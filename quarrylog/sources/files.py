"""Log files: listing, heads, formats, and lines with their numbers.

Paths may be on any file system that Spark reads; the driver opens files
through Hadoop's API only, and only their first bytes.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_bytes, rstrip

MAX_FILE_MB = 100
HEAD = 65_536
ARRAY_PROBE = 4096
SAMPLED = 5
#: Files that the driver has open at once.
OPEN_AT_ONCE = 32
#: Rows of files or splits, of some hundred bytes each, that are sent to every task.
FEW = 50_000


@dataclass(frozen=True)
class LogFile:
    name: str
    path: str
    size: int
    modified: datetime

    def too_large(self, max_mb: int = MAX_FILE_MB) -> str | None:
        if self.size > max_mb * 1024 * 1024:
            return f"File too large ({self.size / 1_048_576:.1f} MB). Maximum is {max_mb} MB."
        return None


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, log_dir: str, suffix: str = ".log") -> list[LogFile]:
    """Files of a directory by path, without those below it."""
    fs, p = _fs(spark, log_dir)
    if not fs.exists(p):
        return []
    found = [s for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(suffix)]
    made = lambda s: LogFile(s.getPath().getName(), s.getPath().toString(), s.getLen(), datetime.fromtimestamp(s.getModificationTime() // 1000, timezone.utc))
    return sorted(map(made, found), key=lambda f: f.path)


def resolve(spark: SparkSession, log_dir: str, name: str) -> LogFile:
    """One file of the directory; ValueError for names with a path, FileNotFoundError if there is none."""
    if not name or "/" in name or "\\" in name or name in (".", ".."):
        raise ValueError(f"not a file name: {name!r}")
    fs, p = _fs(spark, f"{log_dir.rstrip('/')}/{name}")
    if not fs.exists(p):
        raise FileNotFoundError(name)
    s = fs.getFileStatus(p)
    return LogFile(name, s.getPath().toString(), s.getLen(), datetime.fromtimestamp(s.getModificationTime() // 1000, timezone.utc))


def readable(spark: SparkSession, log_dir: str, name: str | None = None, max_mb: int = MAX_FILE_MB) -> tuple[list[LogFile], list[dict]]:
    """Files to scan, and those left out for their size; a named file that is too large raises ValueError."""
    if name:
        f = resolve(spark, log_dir, name)
        if f.too_large(max_mb):
            raise ValueError(f.too_large(max_mb))
        return [f], []
    files = list_files(spark, log_dir)
    return [f for f in files if not f.too_large(max_mb)], [{"file": f.name, "reason": f.too_large(max_mb)} for f in files if f.too_large(max_mb)]


def listing(spark: SparkSession, log_dir: str, max_mb: int = MAX_FILE_MB, status: dict[str, dict] | None = None) -> DataFrame:
    """name, path, size_bytes, size_human, modified, live, source, status, warning of each log file.

    ``status`` has the live sources by name: ``<name>.log`` is the file of each.
    """
    status = status or {}
    rows = []
    for f in list_files(spark, log_dir):
        root = f.name.removesuffix(".log")
        live = status.get(root)
        rows.append((f.name, f.path, f.size, f.modified, live is not None, root if live else None, (live or {}).get("status"), f.too_large(max_mb)))
    made = spark.createDataFrame(rows, "name string, path string, size_bytes long, modified timestamp, live boolean, source string, status string, warning string")
    return made.withColumn("size_human", human_bytes(F.col("size_bytes"))).orderBy("path")


def head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def _json(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def detect_format(first: bytes) -> str:
    """plain, json_lines or json_array, by the first five lines that aren't blank."""
    text = first.decode("utf-8", "replace")
    lines = [x.strip() for x in text.split("\n") if x.strip()][:SAMPLED]
    if not lines:
        return "plain"
    if lines[0].startswith("["):
        probe = first[:ARRAY_PROBE].decode("utf-8", "ignore").strip()
        for attempt in (probe, probe + "]"):
            got = _json(attempt)
            if isinstance(got, list):
                return "json_array" if got and all(isinstance(x, dict) for x in got) else "plain"
        return "plain"
    return "json_lines" if all(isinstance(_json(x), dict) for x in lines) else "plain"


_formats: dict[tuple[str, datetime, int], str] = {}


def formats(spark: SparkSession, files: Sequence[LogFile]) -> dict[str, str]:
    """The format of each file by name, remembered by path, time and size; heads of new files are read side by side."""
    key = lambda f: (f.path, f.modified, f.size)
    new = [f for f in files if key(f) not in _formats]
    with ThreadPoolExecutor(OPEN_AT_ONCE) as pool:
        for f, first in zip(new, pool.map(lambda f: head(spark, f.path), new)):
            _formats[key(f)] = detect_format(first)
    return {f.name: _formats[key(f)] for f in files}


def few(table: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` short rows to join with: sent to every task up to FEW of them, beyond that as Spark sees fit."""
    return F.broadcast(table) if rows <= FEW else table


def numbered_lines(spark: SparkSession, files: Sequence[LogFile]) -> DataFrame:
    """(file, path, line_number, content): right-trimmed lines, numbered from 1, blank lines counted.

    Files are read in splits, as Spark's text reader cuts them.  A first scan
    counts the lines of each split; a second adds the counts of the splits
    before to a line's place in its own.  No line is shuffled and no file has
    to fit in a task.
    """
    if not files:
        return spark.createDataFrame([], "file string, path string, line_number long, content string")
    raw = spark.read.option("lineSep", "\n").text([f.path for f in files])
    meta = F.col("_metadata")
    raw = raw.select("value", meta["file_name"].alias("file"), meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    offset, rows = {}, []
    for b in sorted(blocks, key=lambda b: (b["path"], b["start"])):
        rows.append((b["path"], b["start"], offset.get(b["path"], 0) + 1 - b["first"]))
        offset[b["path"]] = offset.get(b["path"], 0) + b["n"]
    shift = spark.createDataFrame(rows, "path string, start long, shift long")
    joined = raw.join(few(shift, len(rows)), ["path", "start"])
    return joined.select("file", "path", (F.col("id") + F.col("shift")).alias("line_number"), rstrip(F.col("value")).alias("content"))


def array_entries(spark: SparkSession, files: Sequence[LogFile]) -> DataFrame:
    """(file, path, line_number, content): the objects of files that hold one JSON array, numbered from 1."""
    if not files:
        return spark.createDataFrame([], "file string, path string, line_number long, content string")
    whole = spark.read.text([f.path for f in files], wholetext=True).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))
    items = F.filter(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    rows = whole.select("file", "path", F.posexplode(items).alias("pos", "v"))
    return rows.select("file", "path", (F.col("pos") + 1).cast("long").alias("line_number"), F.to_json("v").alias("content"))


def remove_old(spark: SparkSession, log_dir: str, days: int, now: datetime | None = None) -> list[str]:
    """Delete log files older than ``days``, but no links; returns their names."""
    now = now or datetime.now(timezone.utc)
    gone = []
    for f in list_files(spark, log_dir):
        fs, p = _fs(spark, f.path)
        if (now - f.modified).total_seconds() > days * 86_400 and not fs.getFileLinkStatus(p).isSymlink():
            fs.delete(p, False)
            gone.append(f.name)
    return gone
