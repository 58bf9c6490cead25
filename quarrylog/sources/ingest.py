"""Commands as sources: their output goes, tagged, to files that rotate; commands that end are started again."""

from __future__ import annotations

import os
import re
import subprocess
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]*")
CHUNK = 65_536


@dataclass(frozen=True)
class CommandSource:
    name: str
    command: str
    argv: tuple[str, ...]


def _scan(text: str, ends: str, keep: bool) -> list[str]:
    """Cut at unquoted characters of ``ends``; ``keep`` leaves quotes and backslashes as they are."""
    parts: list[str] = []
    current: str | None = None
    quote, k = "", 0
    while k < len(text):
        c, nxt = text[k], text[k + 1 : k + 2]
        if c == "\\" and nxt and quote != "'":
            plain = not keep and (quote == "" or nxt in '"\\')
            current = (current or "") + (nxt if plain else c + nxt)
            k += 2
            continue
        if quote:
            if c == quote:
                quote = ""
                c = c if keep else ""
            current = (current or "") + c
        elif c in "'\"":
            quote = c
            current = (current or "") + (c if keep else "")
        elif c in ends:
            if current is not None:
                parts.append(current)
            current = None
        else:
            current = (current or "") + c
        k += 1
    if quote:
        raise ValueError(f"unterminated {quote} quote")
    return parts + ([current] if current is not None else [])


def tokenize(command: str) -> list[str]:
    """Words as a shell would cut them, without any shell."""
    return _scan(command, " \t", False)


def parse_sources(raw: str | None) -> list[CommandSource]:
    """``name:cmd=command; name:cmd=command``; a mistake raises ValueError."""
    out: list[CommandSource] = []
    for entry in filter(None, map(str.strip, _scan(raw or "", ";", True))):
        name, colon, rest = entry.partition(":")
        name = name.strip()
        if not colon or not rest.startswith("cmd="):
            raise ValueError(f"malformed source {entry!r}: expected name:cmd=command")
        if not NAME.fullmatch(name):
            raise ValueError(f"invalid source name {name!r}")
        command = rest[4:].strip()
        argv = tokenize(command)
        if not argv:
            raise ValueError(f"empty command in {entry!r}")
        if any(s.name == name for s in out):
            raise ValueError(f"duplicate source name {name!r}")
        out.append(CommandSource(name, command, tuple(argv)))
    return out


@dataclass(frozen=True)
class Backoff:
    """Delays that double up to ``most``, and start anew after a run of ``healthy`` seconds."""

    first: float = 1.0
    most: float = 60.0
    healthy: float = 30.0

    def after(self, queued: float, uptime: float) -> tuple[float, float]:
        """(delay now, delay queued for the next failure)."""
        delay = self.first if uptime >= self.healthy else min(queued, self.most)
        return delay, min(delay * 2, self.most)


@dataclass
class RotatingFile:
    """``name.log`` that moves to ``name.1.log`` before a line would take it past ``most_bytes``."""

    folder: Path
    name: str
    most_bytes: int = 50 * 1024 * 1024
    keep: int = 3

    def path(self, k: int = 0) -> Path:
        return Path(self.folder) / (f"{self.name}.{k}.log" if k else f"{self.name}.log")

    def append(self, data: bytes) -> None:
        size = self.path().stat().st_size if self.path().exists() else 0
        if size and size + len(data) > self.most_bytes:
            self.rotate()
        with self.path().open("ab") as f:
            f.write(data)

    def rotate(self) -> None:
        self.path(self.keep).unlink(missing_ok=True)
        for k in range(self.keep - 1, -1, -1):
            if self.path(k).exists():
                if k + 1 > self.keep or self.keep == 0:
                    self.path(k).unlink()
                else:
                    os.replace(self.path(k), self.path(k + 1))


@dataclass
class Worker:
    """Runs one command on a thread: each line of its output is tagged and appended."""

    source: CommandSource
    out: RotatingFile
    backoff: Backoff = field(default_factory=Backoff)
    sleep: Callable[[float], None] | None = None
    most_runs: int | None = None
    status: str = "starting"
    lines: int = 0
    runs: int = 0

    def __post_init__(self) -> None:
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._process: subprocess.Popen | None = None

    def start(self) -> Worker:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._process and self._process.poll() is None:
            self._process.terminate()
        self._thread.join(10)
        self.status = "dead"

    def join(self, timeout: float) -> None:
        self._thread.join(timeout)

    def _run(self) -> None:
        queued = self.backoff.first
        while not self._stop.is_set():
            began = time.monotonic()
            try:
                self._process = subprocess.Popen(self.source.argv, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, stdin=subprocess.DEVNULL)
                self.status = "running"
                self._tee(self._process)
            except OSError:
                pass
            self.runs += 1
            if self.most_runs is not None and self.runs >= self.most_runs:
                break
            delay, queued = self.backoff.after(queued, time.monotonic() - began)
            self.status = "backing_off"
            (self.sleep or self._stop.wait)(delay)
        self.status = "dead"

    def _tee(self, process: subprocess.Popen) -> None:
        held = b""
        tag = f"[src:{self.source.name}] ".encode()
        while chunk := process.stdout.read1(CHUNK):
            *whole, held = (held + chunk).split(b"\n")
            for line in whole:
                self.out.append(tag + line.rstrip(b"\r") + b"\n")
                self.lines += 1
        if held:
            self.out.append(tag + held + b"\n")
            self.lines += 1
        process.wait()
