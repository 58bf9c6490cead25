"""A store of log lines beside the log directory, from which bounded queries read only what may matter.

Lines are kept as Parquet, by file and in order, with their timestamps; row
groups carry the bounds of these, so a time filter leaves most of a store
unread.  Lines without a timestamp are always read, as they pass any time
filter.  A file is read from the store only while its size and time are those
that the store saw; changed files are read as they are until the next refresh.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.fields import MOST_PATHS, absent, paths
from ..sources.files import LogFile, few, formats, list_files
from .lines import RAW, LineOptions, enrich, log_lines
from .zone_map import stored

MANIFEST = "manifest.json"


class LineStore:
    """The stored lines of a directory's log files; ``options`` are those that queries use."""

    def __init__(self, spark: SparkSession, path: str, options: LineOptions = LineOptions()) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self._lock, self._stop, self._thread = threading.Lock(), threading.Event(), None

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict[str, dict]:
        """By file name: size, modified, kind, part (its folder), entries, others, and the known and opaque field paths of its entries."""
        fs, p = self._file(MANIFEST)
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write_manifest(self, entries: dict[str, dict]) -> None:
        fs, p = self._file(MANIFEST)
        out = fs.create(p, True)
        try:
            out.write(json.dumps(entries).encode("utf-8"))
        finally:
            out.close()

    @staticmethod
    def _state(f: LogFile) -> dict:
        return {"size": f.size, "modified": f.modified.isoformat()}

    def holds(self, entries: dict[str, dict], f: LogFile) -> bool:
        return f.name in entries and all(entries[f.name][k] == v for k, v in self._state(f).items())

    def refresh(self, files: Sequence[LogFile]) -> list[str]:
        """Store the files that are new or changed, and forget those that are gone; returns the names of what was stored."""
        with self._lock:
            entries = self.manifest()
            changed = [f for f in files if not self.holds(entries, f)]
            names = {f.name for f in files}
            kept = {n: e for n, e in entries.items() if n in names}
            if changed:
                part, kinds = f"part-{uuid.uuid4().hex}", formats(self.spark, changed)
                lines = log_lines(self.spark, changed, self.options).select(*RAW, "ts_line", "ts_entry", "is_entry", "v")
                surveyed = self._survey(lines)
                flat = lines.drop("v", "is_entry").repartitionByRange("file", "line_number").sortWithinPartitions("file", "line_number")
                flat.write.mode("overwrite").option("parquet.block.size", str(16 << 20)).parquet(f"{self.path}/{part}")
                for f in changed:
                    kept[f.name] = self._state(f) | {"kind": kinds[f.name], "part": part} | surveyed.get(f.name, {"entries": 0, "others": 0, "known": [], "opaque": []})
            if changed or kept != entries:
                self._write_manifest(kept)
                self._drop({e["part"] for e in entries.values()} - {e["part"] for e in kept.values()})
            return [f.name for f in changed]

    def _survey(self, lines: DataFrame) -> dict[str, dict]:
        """Entries, other lines and field paths by file; of a file with more than MOST_PATHS paths one too many, which proves nothing."""
        found = {r["file"]: {"entries": r["entries"], "others": r["others"], "known": [], "opaque": []} for r in lines.groupBy("file").agg(F.count_if("is_entry").alias("entries"), F.count_if(~F.col("is_entry")).alias("others")).collect()}
        nth = F.row_number().over(Window.partitionBy("file").orderBy("path"))
        for r in paths(lines).withColumn("n", nth).where(F.col("n") <= MOST_PATHS + 1).collect():
            found[r["file"]]["known"].append(r["path"])
            if r["opaque"]:
                found[r["file"]]["opaque"].append(r["path"])
        return found

    def _drop(self, parts: set[str]) -> None:
        for part in parts:
            fs, p = self._file(part)
            fs.delete(p, True)

    def totals_without(self, files: Sequence[LogFile], field: str) -> dict[str, int] | None:
        """Entries and other lines of the files, if their surveys prove that none has the field; None if one doesn't."""
        entries = self.manifest()
        if not files or not all(self.holds(entries, f) and absent(set(entries[f.name]["known"]), set(entries[f.name]["opaque"]), field) for f in files):
            return None
        return {k: sum(entries[f.name][k] for f in files) for k in ("entries", "others")}

    def lines(self, files: Sequence[LogFile], since: datetime | None, until: datetime | None, as_lines: bool = False) -> DataFrame:
        """Canonical lines of the files that may lie within the bounds: from the store where it holds a file, else from the file.

        ``as_lines`` takes JSON files as plain text too.
        """
        entries = self.manifest()
        held = [f for f in files if self.holds(entries, f) and not (as_lines and entries[f.name]["kind"] == "json_array")]
        rest = [f for f in files if f not in held]
        frames = []
        for part in sorted({entries[f.name]["part"] for f in held}):
            for way in ("line", "entry"):
                names = [f.name for f in held if entries[f.name]["part"] == part and ("line" if as_lines or entries[f.name]["kind"] == "plain" else "entry") == way]
                if names:
                    frames.append(stored(self.spark, f"{self.path}/{part}", since, until, way).where(F.col("file").isin(names)))
        if rest:
            frames.append(log_lines(self.spark, rest, self.options, as_lines))
        raw = [f.select("file", "line_number", "content", F.lit("plain").alias("format") if as_lines else F.col("format"), "mtime") for f in frames]
        order = self.spark.createDataFrame([(f.name, k) for k, f in enumerate(files)], "file string, file_ord int")
        return enrich(reduce(DataFrame.unionByName, raw).join(few(order, len(files)), "file").select(*RAW), self.options)

    def watch(self, log_dir: str, seconds: float = 60.0) -> None:
        """Refresh in the background, again and again, until ``close``."""

        def run() -> None:
            while not self._stop.is_set():
                self.refresh(list_files(self.spark, log_dir))
                self._stop.wait(seconds)

        self._thread = threading.Thread(target=run, name="line-store", daemon=True)
        self._thread.start()

    def close(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
