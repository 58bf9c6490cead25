"""Copies of logs from object stores, through Hadoop's file systems instead of command lines."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import SparkSession

# Schemes of the stores, and the names that Hadoop's connectors go by.
SCHEMES = {"gs": "gs", "s3": "s3a", "az": "wasbs", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs"}


COPY_AT_ONCE = 16


def resolve_scheme(source: str) -> str:
    scheme, mark, rest = source.partition("://")
    if not mark or scheme not in SCHEMES:
        raise ValueError(f"unknown source {source!r}: expected gs://, s3:// or az://")
    return f"{SCHEMES[scheme]}://{rest}"


def sync(spark: SparkSession, source: str, log_dir: str, prefix: str = "", since: datetime | None = None) -> dict:
    """Copy ``source``'s files that start with ``prefix`` and were modified strictly after ``since`` to the log directory.

    Files that are there already with the same size and no older are left.
    Returns how many were listed, selected and copied.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    src = jvm.org.apache.hadoop.fs.Path(resolve_scheme(source))
    fs = src.getFileSystem(conf)
    dst_dir = jvm.org.apache.hadoop.fs.Path(log_dir)
    dst_fs = dst_dir.getFileSystem(conf)
    dst_fs.mkdirs(dst_dir)
    listed, selected = 0, []
    files = fs.listFiles(src, True)
    while files.hasNext():
        s = files.next()
        listed += 1
        name = s.getPath().getName()
        if name.startswith(prefix) and (since is None or s.getModificationTime() > since.timestamp() * 1000):
            selected.append(s)

    def copy(s) -> str | None:
        target = jvm.org.apache.hadoop.fs.Path(dst_dir, s.getPath().getName())
        if dst_fs.exists(target):
            there = dst_fs.getFileStatus(target)
            if there.getLen() == s.getLen() and there.getModificationTime() >= s.getModificationTime():
                return None
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, s.getPath(), dst_fs, target, False, True, conf)
        return s.getPath().getName()

    with ThreadPoolExecutor(COPY_AT_ONCE) as pool:  # bytes stream through this JVM, many files at a time
        copied = [name for name in pool.map(copy, selected) if name]
    return {"listed": listed, "selected": len(selected), "copied": sorted(copied)}
