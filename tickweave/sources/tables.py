"""Partitioned parquet tables: scans with defaults, pruning, and the sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.schemas import nan_to_null
from tickweave.session import materialise

KEYS = ("symbol", "day")


def keyed(schema: T.StructType) -> T.StructType:
    """A stream schema with its partition columns."""
    return T.StructType([*schema.fields, T.StructField("symbol", T.StringType()), T.StructField("day", T.DateType())])


def read_table(spark: SparkSession, path: str, schema: T.StructType, required: bool = True) -> DataFrame:
    """A table by its declared schema. A missing optional table is an empty one; a missing required one raises."""
    try:
        df = spark.read.schema(keyed(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if required:
            raise FileNotFoundError(f"missing table {path}") from e
        return spark.createDataFrame([], keyed(schema))
    return nan_to_null(df)


def between_days(df: DataFrame, start: str | None = None, end: str | None = None, day: str = "day") -> DataFrame:
    """Inclusive day range on the partition column, so whole folders are skipped."""
    if start is not None:
        df = df.where(F.col(day) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(day) <= F.lit(end).cast("date"))
    return df


def select_symbols(df: DataFrame, symbols, key: str = "symbol") -> DataFrame:
    """The slabs of the named symbols; a symbol without rows is an error. The names are an argument list."""
    found = {r[0] for r in df.where(F.col(key).isin(list(symbols))).select(key).distinct().collect()}
    gone = [s for s in symbols if s not in found]
    if gone:
        raise FileNotFoundError(f"no slab for {gone}")
    return df.where(F.col(key).isin(list(symbols)))


def columns(df: DataFrame, wanted) -> DataFrame:
    """Only what is needed; the scan reads no other column."""
    return df.select(*wanted)


def latest_version(spark: SparkSession, glob: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of the last file in name order, for reference tables kept as dated files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    files = reader.parquet(glob).withColumn("_name", F.col("_metadata.file_name"))
    newest = files.agg(F.max("_name").alias("n")).first().n
    return files.where(F.col("_metadata.file_name") == newest).drop("_name")


def row_count(df: DataFrame) -> int:
    """Rows without reading a column; parquet answers from its footers."""
    return df.count()


def footer_facts(spark: SparkSession, path: str, columns=(), by=KEYS) -> DataFrame:
    """``n_rows`` and ``min_<c>``, ``max_<c>`` of ``columns`` per partition, answered by the parquet footers.

    ``by`` names all partition columns. The aggregate is pushed into the scan, so no page of
    data is read. The settings that this needs are put back; the result is written.
    """
    conf = spark.conf
    keep = [x for x in conf.get("spark.sql.sources.useV1SourceList").split(",") if x and x != "parquet"]
    wanted = {"spark.sql.sources.useV1SourceList": ",".join(keep), "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        return materialise(_footer_query(spark.read.parquet(path), columns, by), "footers")
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _footer_query(df: DataFrame, columns, by) -> DataFrame:
    ends = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *ends)


def stored_tail(df: DataFrame, n: int, total: int, pos: str = "pos") -> DataFrame:
    """Last ``n`` rows of a slab stored with its positions; row groups before the cut are skipped."""
    return df.where(F.col(pos) >= total - n)


def first_rows(df: DataFrame, n: int, order=("ts_ms",)) -> DataFrame:
    """The first ``n`` rows by order (a sampling operator)."""
    return df.orderBy(*order).limit(n)


def write_table(df: DataFrame, path: str, keys=KEYS) -> None:
    """Zstd parquet by partition; only the partitions present in ``df`` are replaced.

    The rebalance step gathers a partition's rows into few files, and splits a
    partition that is much larger than the others.
    """
    (
        df.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite").partitionBy(*keys)
        .option("compression", "zstd").option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def listing(spark: SparkSession, path: str, contains: str | None = None) -> DataFrame:
    """Files under a path as ``(key, size)``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = files.select(F.col("path").alias("key"), F.col("length").alias("size"))
    return out.where(F.contains("key", F.lit(contains))) if contains else out


def not_mirrored(source: DataFrame, target: DataFrame, source_root: str, target_root: str) -> DataFrame:
    """Files of ``source`` whose relative name is absent from ``target``."""
    def relative(df: DataFrame, root: str) -> DataFrame:
        return df.withColumn("name", F.substring_index("key", root.rstrip("/") + "/", -1))

    return relative(source, source_root).join(relative(target, target_root).select("name"), "name", "left_anti")
