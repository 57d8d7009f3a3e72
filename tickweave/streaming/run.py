"""Sources, sinks and the run loop shared by the streaming operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.session import ROCKSDB_PROVIDER, new_path


def file_stream(spark: SparkSession, paths: list[str], schema, per_trigger: int = 1) -> DataFrame:
    """Stream over parquet globs of one file system, oldest file first.

    A file source takes one path, so several are written as one alternation below the root of
    their file system. Paths without a scheme count as those of the others' file system.
    """
    path = paths[0]
    if len(paths) > 1:
        parts = [re.fullmatch(r"(\w[\w+.-]*:(?://[^/]*)?)?/*(.*)", p).groups() for p in paths]
        # file: and file:// name the same root
        roots = {root.rstrip("/") for root, _ in parts if root}
        if len(roots) > 1:
            raise ValueError(f"one stream reads one file system, not {sorted(roots)}")
        path = "".join(roots) + "/{" + ",".join(rest for _, rest in parts) + "}"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def run_to_end(df: DataFrame, label: str, mode: str = "append", batch=None, watch: list | None = None) -> str:
    """Run with the available-now trigger and return the folder of results; ``watch`` gets the progress of all micro-batches.

    Every micro-batch overwrites its own ``batch_id`` folder, so a replayed batch
    leaves the same files. ``batch`` may split the micro-batch into named sinks.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")

    def write(frame: DataFrame, batch_id: int) -> None:
        for sink, rows in (batch(frame) if batch else {"rows": frame}).items():
            rows.write.mode("overwrite").parquet(f"{out}/sink={sink}/batch_id={batch_id}")

    q = (
        df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        .foreachBatch(write).start()
    )
    q.awaitTermination()
    if watch is not None:
        watch += q.recentProgress
    return out


def results(spark: SparkSession, out: str, sink: str = "rows") -> DataFrame:
    return spark.read.option("basePath", f"{out}/sink={sink}").parquet(f"{out}/sink={sink}/batch_id=*")


def latest(df: DataFrame, keys) -> DataFrame:
    """Update-mode results: the row of the newest batch per key."""
    rest = [c for c in df.columns if c not in (*keys, "batch_id")]
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in rest])
