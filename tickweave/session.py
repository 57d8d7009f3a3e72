"""Session settings the operators rely on, and the one way they cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that results and plans depend on; cluster sizing is left alone.

    Wide expression stages can generate methods above 8000 bytes, which the JVM
    never compiles. The limit makes Spark split such stages instead.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(cores: str = "8", app: str = "tickweave") -> SparkSession:
    """A local session for tests and the benchmark.

    Call sites of single column calls are switched off: they cost several round
    trips each when plans are wide, and the setting is static.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` decides. Only where nothing is set (local tests)
    is a folder of our own made and recorded in the session.
    """
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.conf.get("spark.tickweave.shared.dir", None)
        or spark.sparkContext.getCheckpointDir()
    )
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-tickweave-")
        spark.conf.set("spark.tickweave.shared.dir", named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of any executor, keeps column pruning,
    and fixes values that must not change between two reads.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys) -> DataFrame:
    """Hash partition on ``keys`` and keep the partition count as configured.

    For the step before a row-multiplying operator: the shuffled bytes say little
    about the rows to come, so the adaptive coalescing must not merge partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
