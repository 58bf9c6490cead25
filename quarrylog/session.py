"""Session settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for stamps without a zone; JSON with repeated keys stays JSON (the last one counts).
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
