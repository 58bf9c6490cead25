"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: dict[str, SparkSession] = {}
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and there is one process only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrylog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` texts at most: what a Python worker holds at once stays small beside long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def _clearing(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def cleared(df: DataFrame) -> list[Row]:
    """All rows of a small result; the shuffle files of its query go with its end."""
    with _clearing(df.sparkSession):
        return df.select("*").collect()  # a DataFrame keeps the setting that it was made under


def materialize(df: DataFrame, name: str, instead: list[DataFrame] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors.

    Tables in ``instead`` (materialized before, and needed no more) are deleted.
    The shuffle files of the write go with its end: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/quarrylog-{name}-{uuid.uuid4().hex}"
    with _clearing(spark):
        df.write.parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = (table, path)
    drop(*instead or [])
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for table in tables:
        _, path = _paths.pop(id(table))
        _delete(_written.pop(path), path)


def standing() -> set[str]:
    """Paths of the tables that ``materialize`` wrote and that nobody deleted."""
    return set(_written)


def supersede(paths: Iterable[str], docs: DataFrame) -> None:
    """Delete the tables at ``paths``, but for those that ``docs`` reads."""
    read = {part for f in docs.inputFiles() for part in f.split("/")}
    for path in [p for p in paths if p in _written and p.rsplit("/", 1)[1] not in read]:
        for k in [k for k, (_, p) in _paths.items() if p == path]:
            del _paths[k]
        _delete(_written.pop(path), path)


def free(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores behind it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _forget() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended before
            return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def raw_text(c: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(c), F.lit("")).cast("binary")


def bounded_sample(df: DataFrame, most: int, seed: int, *by: str) -> DataFrame:
    """About ``most`` rows (all, if there are no more), drawn by a hash of ``by``, which is added as __order.

    A threshold on the hash: no task and no driver ever holds more than the
    sample, whatever the number of partitions.
    """
    n = df.count()
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in by])
    drawn = df.withColumn("__order", key)
    return drawn if n <= most else drawn.where(F.pmod("__order", F.lit(1 << 40)) < int(most / n * (1 << 40)))


def in_order(rows: list) -> list:
    """Collected rows of a bounded sample, in order of their hash."""
    return sorted(rows, key=lambda r: (r["__order"], str(r)))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Cut batches that are sorted by ``keys`` into tables in which each group is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[-1].as_py() for k in keys]
        changed = np.ones(table.num_rows, dtype=bool)
        for k, v in zip(keys, last):
            col = table.column(k)
            changed &= np.asarray(pa.compute.equal(col, pa.scalar(v, col.type)))
        cut = int(np.argmax(changed)) if changed.any() else table.num_rows
        if cut == 0:
            held = table.combine_chunks().to_batches()
            continue
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, component), the smallest node that is reachable.

    Smallest-label propagation with pointer jumping: each round is one
    aggregation over the links and one self-join of the labels, all of it
    shuffled by node, with the labels written to the shared folder.  Nodes
    without a link don't appear.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = materialize(both, "links")
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    label = materialize(label, "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = label.select("node", "component").join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("to"))
        step = materialize(step, "labels", [label])
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = step.join(jump, "to").select("node", F.least("to", "further").alias("component"), (F.least("to", "further") != F.col("was")).alias("moved"))
        label = materialize(new, "labels", [step])
        if label.where("moved").isEmpty():
            drop(both)
            return label.select("node", "component")
