"""Cursors for polling a growing file: only whole lines that were appended since, or everything, flagged, after a rotation."""

from __future__ import annotations

import base64
import json
import zlib
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

VERSION = 2
SIGNED = 256
#: Bytes that the driver reads at once, and of a whole file it counts itself.
CHUNK = 1 << 20
COUNT_HERE = 4 << 20


@dataclass(frozen=True)
class Cursor:
    """End of the last whole line (offset and number), and a checksum of the file's first bytes."""

    file: str
    offset: int
    lines: int
    signed: int
    signature: int

    def encode(self) -> str:
        return base64.urlsafe_b64encode(json.dumps([VERSION, *asdict(self).values()]).encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, token: str) -> Cursor | None:
        """None for anything that isn't a cursor of this version."""
        try:
            version, file, *numbers = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        except (ValueError, TypeError):
            return None
        good = version == VERSION and isinstance(file, str) and len(numbers) == 4 and all(type(n) is int and n >= 0 for n in numbers)
        return cls(file, *numbers) if good else None

    @classmethod
    def at_end(cls, file: str, content: bytes) -> Cursor:
        end = content.rfind(b"\n") + 1
        first = content[:SIGNED]
        return cls(file, end, content.count(b"\n", 0, end), len(first), zlib.crc32(first))

    def holds(self, file: str, size: int, first: bytes) -> bool:
        return file == self.file and size >= max(self.offset, self.signed) and zlib.crc32(first[: self.signed]) == self.signature


def numbered(content: bytes, number: int) -> list[tuple[int, str]]:
    """Right-trimmed lines with their numbers; an unfinished last line is one of them."""
    parts = content.decode("utf-8", "replace").split("\n")
    if parts[-1] == "":
        parts.pop()
    return [(number + k, x.rstrip()) for k, x in enumerate(parts)]


@dataclass(frozen=True)
class Poll:
    lines: list[tuple[int, str]]
    cursor: str
    reset: bool


def poll_bytes(file: str, content: bytes, token: str | None) -> Poll:
    """Lines after the cursor, and the next cursor."""
    seen = Cursor.decode(token) if token else None
    valid = seen is not None and seen.holds(file, len(content), content)
    offset, number = (seen.offset, seen.lines + 1) if valid else (0, 1)
    return Poll(numbered(content[offset:], number), Cursor.at_end(file, content).encode(), bool(token) and not valid)


@dataclass(frozen=True)
class Place:
    """Number of the first line after a cursor, the cursor for the next poll, and whether the old one no longer held."""

    first: int
    cursor: str
    reset: bool


def _end_of_lines(stream, start: int, size: int) -> int:
    """Where the last whole line between ``start`` and ``size`` ends, sought from behind; ``start`` if there is none."""
    end = size
    while end > start:
        begin = max(start, end - CHUNK)
        stream.seek(begin)
        at = bytes(stream.readNBytes(end - begin)).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return start


def _line_ends(stream, start: int, end: int) -> int:
    n = 0
    for begin in range(start, end, CHUNK):
        stream.seek(begin)
        n += bytes(stream.readNBytes(min(CHUNK, end - begin))).count(b"\n")
    return n


def poll(spark: SparkSession, file: str, path: str, token: str | None) -> Place:
    """As ``poll_bytes``, of a file on any file system, without its lines.

    With a valid cursor the driver reads what was appended, a chunk at a time;
    without one it reads the file's end only, and Spark counts the lines of a
    large file.  A file that grows meanwhile is looked at again.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    size_now = lambda: fs.getFileStatus(fs_path).getLen()
    size = size_now()
    stream = fs.open(fs_path)
    try:
        first = bytes(stream.readNBytes(SIGNED))
        seen = Cursor.decode(token) if token else None
        valid = seen is not None and seen.holds(file, size, first)
        offset, before = (seen.offset, seen.lines) if valid else (0, 0)
        end, n = _end_of_lines(stream, offset, size), None
        for _ in range(3 if offset == 0 and size > COUNT_HERE else 0):
            rows = spark.read.option("lineSep", "\n").text(path).count()
            if size_now() == size:
                n = rows - (end < size)
                break
            size = size_now()
            end = _end_of_lines(stream, offset, size)
        lines = before + (n if n is not None else _line_ends(stream, offset, end))
    finally:
        stream.close()
    cursor = Cursor(file, end, lines, len(first), zlib.crc32(first))
    return Place(before + 1, cursor.encode(), bool(token) and not valid)
