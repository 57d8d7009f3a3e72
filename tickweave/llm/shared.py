"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from tickweave import session

__all__ = ["documents", "lean", "lean_group", "materialise", "partitions", "shards", "small_batches"]

#: Bytes of text that one vectorised step inside a task works on.
STEP_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the shuffle files of the write go when it ends.

    Nothing reads them again, and without this they stay until the driver happens to collect garbage.
    """
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return session.materialise(df, label)
    finally:
        conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """Bound the rows of an Arrow batch, so that a batch of long texts fits a Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise, and workers are reused by later stages."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(fn: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives its memory back when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from fn(batches)
        give_back()

    return run


def lean_group(fn: Callable) -> Callable:
    """The same for ``applyInArrow``, after every group."""

    def run(table: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        out = fn(table)
        give_back()
        return out

    return run


def shards(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Regroup batches so that one holds about ``limit`` bytes of ``column``; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield _joined(held)
                held, size, start = [], 0, i
            size += n
        if len(lengths) > start:
            held.append(batch.slice(start))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
