"""Questions of blocks of documents to the owners of values, and the answers.

A map task works through its documents in blocks. What a block wants to know about values
that other blocks hold too (a pair's count, a chunk's encoding) it asks once per value: the
values of one bucket travel as one packed row. The bucket's owner sees every question about
its values together and packs one answer per question, which goes back to its block. A value
that a third of all documents hold adds one question per block, so no bucket becomes hot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.hashing import mix
from tickweave.llm.shared import lean_group, partitions

#: ``bucket`` is negative for what a block keeps for itself.
ASKED = "block long, bucket int, packed binary"
MOST_BUCKETS = 1 << 20
#: Of the compression: packed values are most of what is shuffled.
LEVEL = 6


def packed(columns: dict[str, pa.Array]) -> bytes:
    """Columns as one compressed value."""
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(value: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch()


def planned_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the planner estimates it: for a table, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets(df: DataFrame, each: int = 8 << 20) -> int:
    """So many buckets that one holds about ``each`` bytes of ``df``; unknown sizes get one per partition."""
    least, planned = partitions(df.sparkSession), planned_bytes(df)
    return min(MOST_BUCKETS, max(least, planned // each)) if planned < 1 << 60 else least


def bucket_of(keys: np.ndarray, count: int) -> np.ndarray:
    """Bucket of every 64-bit key."""
    return (((mix(keys) >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int32)


def rows(block: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """The rows of a block: bucket and packed value."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * len(parts), pa.int64()),
            pa.array([b for b, _ in parts], pa.int32()),
            pa.array([v for _, v in parts], pa.binary()),
        ],
        ["block", "bucket", "packed"],
    )


def answered(asked: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``answer`` for every bucket: a table of its questions to a table of rows of the same shape."""
    return asked.where("bucket >= 0").groupBy("bucket").applyInArrow(lean_group(answer), ASKED)


def through(asked: DataFrame, answer: Callable[[pa.Table], pa.Table], count: int) -> DataFrame:
    """As ``answered``, and what the blocks keep for themselves goes along, so ``asked`` is read once and never stored."""
    owner = F.when(F.col("bucket") < 0, -1 - F.pmod("block", F.lit(count)).cast("int")).otherwise(F.col("bucket"))

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["block", "bucket", "packed"])
        return answer(rows) if rows.column("bucket")[0].as_py() >= 0 else rows

    return asked.withColumn("owner", owner).groupBy("owner").applyInArrow(lean_group(run), ASKED)


def finished(parts: DataFrame, finish: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``finish`` for every block: what it kept and the answers it got, to result rows."""
    return parts.groupBy("block").applyInArrow(lean_group(finish), schema)


def in_order(table: pa.Table) -> tuple[dict[int, pa.RecordBatch], list[pa.RecordBatch]]:
    """What a block kept, by its negative number, and the answers by bucket."""
    parts = sorted(zip(table.column("bucket").to_pylist(), table.column("packed"), strict=True), key=lambda p: p[0])
    return {b: unpacked(v) for b, v in parts if b < 0}, [unpacked(v) for b, v in parts if b >= 0]
