"""Zone maps: what a block of lines can't contain, so that a scan may leave it out.

A block is skipped only if every line in it has a timestamp, by the same way
of finding timestamps as the scan's, and all of them lie outside the bounds:
lines without one pass any time filter.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1000


def block_of(line_number: Column, size: int = BLOCK) -> Column:
    return F.floor((line_number - 1) / size).cast("long")


def zone_map(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """(file, block, rows, min/max and unparsed by line and by entry): one row for each ``size`` lines."""
    ways = [x for way in ("line", "entry") for x in (F.min(f"ts_{way}").alias(f"min_{way}"), F.max(f"ts_{way}").alias(f"max_{way}"), F.count_if(F.col(f"ts_{way}").isNull()).alias(f"unparsed_{way}"))]
    return lines.groupBy("file", block_of(F.col("line_number"), size).alias("block")).agg(F.count("*").alias("rows"), *ways)


def extended(zones: DataFrame, lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """The zone map after lines were appended to its files: the last block of each file, and new ones, are computed anew.

    ``lines`` may hold all lines or, to read less, those from the start of each
    file's last block on.
    """
    last = zones.groupBy("file").agg(F.max("block").alias("last"))
    fresh = lines.withColumn("block", block_of(F.col("line_number"), size)).join(F.broadcast(last), "file", "left").where("last is null or block >= last").drop("block", "last")
    kept = zones.join(F.broadcast(last), "file").where("block < last").drop("last")
    return kept.unionByName(zone_map(fresh, size))


def live_blocks(zones: DataFrame, since: datetime | None, until: datetime | None, way: str = "line") -> DataFrame:
    """(file, block) of the blocks that may hold lines within the bounds."""
    outside = F.lit(False)
    if since is not None:
        outside = outside | (F.col(f"max_{way}") < F.lit(since))
    if until is not None:
        outside = outside | (F.col(f"min_{way}") > F.lit(until))
    skip = (F.col(f"unparsed_{way}") == 0) & F.coalesce(outside, F.lit(False))
    return zones.where(~skip).select("file", "block")


def pruned(lines: DataFrame, zones: DataFrame, since: datetime | None, until: datetime | None, way: str = "line", size: int = BLOCK) -> DataFrame:
    """Lines of the blocks that may matter; a time filter over them gives what it gives over all lines."""
    return lines.withColumn("block", block_of(F.col("line_number"), size)).join(live_blocks(zones, since, until, way), ["file", "block"], "left_semi").drop("block")


def store(lines: DataFrame, path: str, size: int = BLOCK) -> None:
    """Write lines as Parquet, by file and in order, so that row groups carry the bounds of their timestamps."""
    kept = lines.select("file", "file_ord", "line_number", "content", "format", "mtime", "ts_line", "ts_entry", block_of(F.col("line_number"), size).alias("block"))
    kept.repartitionByRange("file", "line_number").sortWithinPartitions("file", "line_number").write.mode("overwrite").option("parquet.block.size", str(16 << 20)).parquet(path)


def stored(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None, way: str = "line") -> DataFrame:
    """Stored lines within the bounds, and those without a timestamp; the filter reaches Parquet's row groups."""
    ts = F.col(f"ts_{way}")
    got = spark.read.parquet(path)
    if since is not None:
        got = got.where(ts.isNull() | (ts >= F.lit(since)))
    if until is not None:
        got = got.where(ts.isNull() | (ts <= F.lit(until)))
    return got
