"""Tables whose days appear only once they are committed.

A run writes its rows to a folder of its own; a commit record per key then names the run
that holds it. Readers and the work plan follow the records, so a job that is stopped in
between leaves the earlier rows readable and its days pending. Nothing is overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.sources.tables import KEYS


def _records(spark: SparkSession, root: str, schema: T.StructType, keys) -> DataFrame:
    names = T.StructType([*[schema[k] for k in keys]]).add("run", "string").add("turn", "long").add("n_rows", "long")
    try:
        return spark.read.schema(names).parquet(f"{root}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], names)


def _rows(spark: SparkSession, path: str, schema: T.StructType, keys, *extra: T.StructField) -> DataFrame:
    stored = [f for f in schema.fields if f.name not in keys]
    return spark.read.schema(T.StructType([*stored, *extra, *[schema[k] for k in keys]])).parquet(path)


def stage(df: DataFrame, root: str, keys=KEYS) -> str:
    """Write the rows of a run, zstd parquet by key, and return its name. Nobody sees them yet."""
    run = uuid.uuid4().hex
    spread = df.hint("rebalance", *[F.col(k) for k in keys])
    spread.write.partitionBy(*keys).option("compression", "zstd").parquet(f"{root}/data/run={run}")
    return run


def commit(spark: SparkSession, root: str, run: str, schema: T.StructType, keys=KEYS) -> None:
    """Make all keys of a run visible at once, in place of earlier runs' rows for them."""
    last = _records(spark, root, schema, keys).agg(F.max("turn")).first()[0]
    held = _rows(spark, f"{root}/data/run={run}", schema, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    turn = F.lit(0 if last is None else last + 1).cast("long")
    records = held.select(*keys, F.lit(run).alias("run"), turn.alias("turn"), "n_rows")
    records.write.mode("append").parquet(f"{root}/commits")


def write_committed(df: DataFrame, root: str, keys=KEYS) -> str:
    run = stage(df, root, keys)
    commit(df.sparkSession, root, run, df.schema, keys)
    return run


def committed(spark: SparkSession, root: str, schema: T.StructType, keys=KEYS) -> DataFrame:
    """``keys, run, n_rows`` of the newest commit of every key; runs of one turn are taken by name."""
    newest = F.max(F.struct("turn", "run", "n_rows")).alias("c")
    return _records(spark, root, schema, keys).groupBy(*keys).agg(newest).select(*keys, "c.run", "c.n_rows")


def read_committed(spark: SparkSession, root: str, schema: T.StructType, keys=KEYS) -> DataFrame:
    """The committed rows. Run and keys are folders, so the join with the records prunes what it doesn't name."""
    done = committed(spark, root, schema, keys).drop("n_rows")
    run = T.StructField("run", T.StringType())
    try:
        rows = _rows(spark, f"{root}/data", schema, keys, run)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.join(done, ["run", *keys]).select(*schema.names)
