"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset and there is one process only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrylog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; what is there at the end of the session is deleted."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


@atexit.register
def _forget() -> None:
    for path, spark in list(_made.items()):
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended before
            return
