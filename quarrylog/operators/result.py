"""What an operator returns: rows, and one row of counters about what the rows leave out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Result:
    rows: DataFrame
    facts: DataFrame


class Omissions(dict):
    """Which bounds were hit; empty for a complete result."""

    def cap(self, key: str, total: int, shown: int, showing: str) -> Omissions:
        if total > shown:
            self[key] = {"omitted": total - shown, "showing": showing}
        return self

    def omitted(self, key: str, n: int, showing: str) -> Omissions:
        if n > 0:
            self[key] = {"omitted": n, "showing": showing}
        return self

    def capped_at(self, key: str, cap: int) -> Omissions:
        self[key] = {"capped_at": cap}
        return self

    def skipped(self, files: list[dict]) -> Omissions:
        if files:
            self["skipped_files"] = [*self.get("skipped_files", []), *files]
        return self

    def attach(self, result: dict) -> dict:
        return result | {"omissions": dict(self)} if self else result
