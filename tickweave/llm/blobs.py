"""Fixed-size summaries of a whole corpus, and records that travel through a shuffle as blocks.

A summary is one numpy array per task, cut into slices; slices are merged by a shuffle and
only the merged array, whose size does not depend on the input, reaches the driver.

Records of a few bytes each would cost a shuffle row each. A task packs those of one bucket
into one binary value instead, so the shuffle moves blocks and a bucket is read as an array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickweave.llm.shared import lean, lean_group

SLICES = 64
SUMMARY = "slice int, part binary"
BLOCKS = "bucket int, block binary"


def slices(array: np.ndarray) -> pa.RecordBatch:
    """The rows of one task's summary; slices of zeros are left out."""
    import zstandard

    pack = zstandard.ZstdCompressor(1).compress
    parts = [(i, pack(x.tobytes())) for i, x in enumerate(np.split(array, SLICES)) if x.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["slice", "part"]
    )


def merged(parts: DataFrame, size: int, dtype: type, join: Callable) -> np.ndarray:
    """Merge summaries by ``join`` (such as ``np.add``) and bring the one array of ``size`` to the driver."""
    each = size // SLICES

    def reduce(table: pa.Table) -> pa.Table:
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        total = np.zeros(each, dtype)
        for x in table.column("part"):
            join(total, np.frombuffer(unzip(x.as_py()), dtype), out=total)
        return pa.table({"slice": table.column("slice")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size, dtype)
    for row in parts.select("slice", "part").groupBy("slice").applyInArrow(lean_group(reduce), SUMMARY).collect():
        out[row.slice * each : (row.slice + 1) * each] = np.frombuffer(row.part, dtype)
    return out


class Tally:
    """Counts how often each of ``cells`` numbers occurs; many small additions are counted in one go."""

    def __init__(self, cells: int, held: int = 1 << 20):
        self.total, self.limit, self.held, self.size = np.zeros(cells, np.uint32), held, [], 0

    def add(self, numbers: np.ndarray) -> None:
        self.held.append(numbers.astype(np.int32))
        self.size += len(numbers)
        if self.size >= self.limit:
            self.counts()

    def counts(self) -> np.ndarray:
        for numbers in self.held and [np.concatenate(self.held)]:
            self.total += np.bincount(numbers, minlength=len(self.total)).astype(np.uint32)
        self.held, self.size = [], 0
        return self.total


class Bloom:
    """A set of 64-bit values with false positives but no misses, of fixed size whatever its content."""

    BITS = 25

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << Bloom.BITS) - 1)
        v = values.astype(np.int64).view(np.uint64)
        return (v & mask).astype(np.int64), ((v >> np.uint64(34)) & mask).astype(np.int64)

    @staticmethod
    def of(values: DataFrame) -> Bloom:
        """Of the one long column of ``values``; the values are hashes already."""

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << (Bloom.BITS - 3), np.uint8)
            for batch in batches:
                for place in Bloom.places(batch.column(0).to_numpy(zero_copy_only=False)):
                    np.bitwise_or.at(bits, place >> 3, np.uint8(128) >> (place & 7).astype(np.uint8))
            yield slices(bits)

        return Bloom(merged(values.mapInArrow(lean(fill), SUMMARY), 1 << (Bloom.BITS - 3), np.uint8, np.bitwise_or))

    def __contains__(self, value) -> bool:
        return bool(self.find(np.array([value]))[0])

    def find(self, values: np.ndarray) -> np.ndarray:
        a, b = Bloom.places(values)
        test = lambda p: (self.bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1
        return (test(a) & test(b)).astype(bool)


class Dealer:
    """Collects records and deals them out to buckets by a 64-bit key, a block a bucket at a time."""

    def __init__(self, buckets: int, held_bytes: int = 8 << 20):
        self.buckets, self.limit, self.held, self.size = buckets, held_bytes, [], 0

    def add(self, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``records`` has the key in its field ``key``."""
        self.held.append(records)
        self.size += records.nbytes
        if self.size >= self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            records = np.concatenate(self.held)
            self.held, self.size = [], 0
            # the high half of the product is even over the buckets whatever their count is
            bucket = (((records["key"] >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint16) if self.buckets < 65536 else bucket, kind="stable")
            records, bucket = records[order], bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blocks = [x.tobytes() for x in np.split(records, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[first], pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"]
            )


def records(table: pa.Table, dtype: np.dtype) -> np.ndarray:
    """All records of a bucket."""
    blocks = [np.frombuffer(x.as_py(), dtype) for x in table.column("block")]
    return np.concatenate(blocks) if blocks else np.zeros(0, dtype)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every run of equal values."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(key)])
