"""Structured Streaming over log files and event tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.severity import Patterns, level_ordinal, line_level
from ..functions.template import template
from ..functions.text import rstrip
from ..functions.timestamps import line_time, source_of
from ..shared import fresh, remove


def read_live(spark: SparkSession, log_dir: str, patterns: Patterns = Patterns()) -> DataFrame:
    """New lines of the log files of a directory, as a stream: file, instance, content, level, ts, template.

    Whole files are the unit, as of any file stream: point it at files that
    are complete when they appear, such as rotated ones.  Growing files are
    polled with a cursor instead.
    """
    raw = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", "*.log").text(log_dir)
    line = rstrip(F.col("value"))
    out = raw.select(line.alias("content"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"))
    return out.withColumns({
        "instance": F.coalesce(source_of(F.col("content")), F.col("file")),
        "level": level_ordinal(line_level(F.col("content"), patterns)),
        "ts": line_time(F.col("content"), F.col("mtime"))["at"],
        "template": template(F.col("content")),
    })


def live_summary(lines: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Lines and errors of each template and instance by time window; lines later than ``late`` are dropped, unstamped ones have no window."""
    error = F.coalesce(F.col("level") >= 4, F.lit(False))
    return lines.where("ts is not null").withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "template", "instance").agg(F.count("*").alias("lines"), F.count_if(error).alias("errors"))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> StreamingQuery:
    """Take in what there is, batch by batch, and stop; the checkpoint tells the next run where to go on."""
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def window_counts(spark: SparkSession, sf_dir: str, window: str = "6 hours") -> DataFrame:
    """(start, name, lines): events of each type by window, counted by a stream over the table's files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream reads folders
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        stream = reader.parquet(path)
    counted = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", "1 day").groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("name")).agg(F.count("*").alias("lines"))
    base = fresh(spark, "stream")
    run_available(counted, lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out"), "complete", f"{base}/state")
    remove(spark, f"{base}/state")
    return spark.read.parquet(f"{base}/out").select(F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"), "name", "lines")
