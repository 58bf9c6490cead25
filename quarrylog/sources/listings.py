"""Object listings of cloud command lines, parsed as columns; rows of other shapes are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The shapes of the three listings.
GSUTIL = r"^\s*(\d+)\s+(\S+)\s+(gs://\S+)$"
AWS = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})\s+\d+\s+(\S.*)$"
AZ = "^([^\t]+)\t(.*)$"
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def parse_listing(rows: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """(key, modified) of ``gs``, ``s3`` or ``az`` listing lines; times of ``s3`` are taken as UTC."""
    c = F.col(column)
    if kind == "gs":
        key, stamp = F.regexp_extract(c, GSUTIL, 3), F.regexp_extract(c, GSUTIL, 2)
        at = F.when(stamp.rlike(ZONED), F.try_to_timestamp(stamp))
    elif kind == "s3":
        key = F.regexp_extract(c, AWS, 3)
        at = F.try_to_timestamp(F.concat(F.regexp_extract(c, AWS, 1), F.lit("T"), F.regexp_extract(c, AWS, 2), F.lit("Z")))
    elif kind == "az":
        key, stamp = F.regexp_extract(c, AZ, 1), F.trim(F.regexp_extract(c, AZ, 2))
        at = F.when(stamp.rlike(ZONED), F.try_to_timestamp(stamp))
    else:
        raise ValueError(f"unknown listing {kind!r}: gs, s3 or az")
    return rows.select(key.alias("key"), at.alias("modified")).where("key != '' and modified is not null")


def newer(listed: DataFrame, since, prefix: str = "") -> DataFrame:
    """Objects modified strictly after ``since`` whose key starts with ``prefix``."""
    return listed.where((F.col("modified") > F.lit(since)) & F.col("key").startswith(prefix))
