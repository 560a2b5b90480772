"""Helpers shared by the operators of this package."""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Upper bound of one Arrow batch sent to a Python worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a run of very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/corvid-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Reliable checkpoint: the rows are stored in the shared folder (or in ``folder``, which
    ``remove_folder`` takes away when they are done with) and survive lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if folder is None:
        return df.checkpoint(eager=True)
    spark.sparkContext.setCheckpointDir(folder)
    try:
        return df.checkpoint(eager=True)
    finally:
        ensure_checkpoint_dir(spark)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that ``shared_path`` named, with the tables that were ``cut`` into it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_freed(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``cut`` after which the files that its shuffles left on the executors' disks are removed.

    For plans that are run once: what is stored no longer needs them, and else they stay until
    the driver collects its garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return cut(df.select("*"), folder)
    finally:
        spark.conf.set(key, was)


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df``, written to ``path`` in the shared folder in compressed columns and read from there."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_dealt(df: DataFrame) -> DataFrame:
    """``cut`` of a repartitioned table whose partitioning later groupings by the same key use again.

    Spark keeps the partitioning of a checkpoint only if its plan was not adaptive."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return cut(df)
    finally:
        spark.conf.set(key, was)


#: Keys that may hold a share of their own of all rows, at most.
HOT_KEYS = 10_000


def join_by_share(rows: DataFrame, keyed: DataFrame, on: list[str], size_col: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has a row per key and its number of ``rows`` in ``size_col``.

    Keys with more than a ``HOT_KEYS``-th of all ``total`` rows are broadcast (there are no
    more than ``HOT_KEYS`` of them), so no task gets all rows of a hot key."""
    hot = keyed.where(F.col(size_col) > total / HOT_KEYS)
    first = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed, on, how)
    return first.unionByName(rest.select(*first.columns))


def dealt(share: float, *cols) -> Column:
    """Whether a row belongs to a sample of ``share`` of all rows, by the 64-bit hash of ``cols``."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*cols) < F.lit(int(share * 2**64) - 2**63)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column; nulls become empty texts.

    Row ``i`` is ``bytes[offsets[i]:offsets[i + 1]]`` (UTF-8)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0]:offsets[-1]]


def row_ranges(offsets: np.ndarray, limit: int):
    """Consecutive row ranges ``(i, j)`` of about ``limit`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + count)`` of every pair."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first - starts, counts)
