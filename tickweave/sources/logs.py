"""Evaluation logs and reward files: nested JSON to step rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.schemas import ContractError

CORRUPT = "_corrupt_record"

EPISODE = T.StructType(
    [
        T.StructField("episode_idx", T.IntegerType()),
        T.StructField("n_steps", T.IntegerType()),
        T.StructField("actions", T.ArrayType(T.IntegerType())),
        T.StructField("rewards", T.ArrayType(T.DoubleType())),
        T.StructField("cum_reward", T.DoubleType()),
        T.StructField("info_first", T.MapType(T.StringType(), T.StringType())),
        T.StructField("info_last", T.MapType(T.StringType(), T.StringType())),
        T.StructField("obs_history", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)
EVAL_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("eval_idx", T.LongType()),
        T.StructField("num_timesteps", T.LongType()),
        T.StructField("episodes", T.ArrayType(EPISODE)),
        T.StructField(CORRUPT, T.StringType()),
    ]
)
REWARDS = T.StructType(
    [
        T.StructField("policy", T.StringType()),
        T.StructField("n_episodes", T.LongType()),
        T.StructField("seed", T.LongType()),
        T.StructField("rewards", T.ArrayType(T.DoubleType())),
        T.StructField("episode_lengths", T.ArrayType(T.LongType())),
        # not in older files: the number of the file's first episode
        T.StructField("first_episode", T.LongType()),
        T.StructField(CORRUPT, T.StringType()),
    ]
)


def _read(spark: SparkSession, path, schema, multiline: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.json(path, multiLine=multiline).withColumn("source", F.col("_metadata.file_path"))


def read_eval_logs(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """Valid records only; a malformed file or line is skipped. ``multiline`` reads one object per file."""
    return _read(spark, path, EVAL_LOG, multiline).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """Files with records that did not parse, how many, and a run name if one was still readable.

    A query on the corrupt column alone is refused by the reader, so a parsed column is read with it.
    """
    bad = _read(spark, path, EVAL_LOG, multiline).where(F.col(CORRUPT).isNotNull())
    return bad.groupBy("source").agg(F.count(F.lit(1)).alias("n_bad"), F.max("run_id").alias("run_id"))


def episode_steps(logs: DataFrame) -> DataFrame:
    """One row per step of every episode."""
    e = logs.select("run_id", "eval_idx", "num_timesteps", F.explode("episodes").alias("e"))
    s = e.select(
        "run_id", "eval_idx", "num_timesteps", F.col("e.episode_idx").alias("episode_idx"),
        F.posexplode(F.arrays_zip(F.col("e.actions").alias("action"), F.col("e.rewards").alias("reward"))).alias("step", "x"),
    )
    return s.select("run_id", "eval_idx", "num_timesteps", "episode_idx", "step", "x.action", "x.reward")


def episode_totals(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id", "eval_idx", "episode_idx").agg(
        F.sum("reward").alias("cum_reward"), F.count(F.lit(1)).alias("n_steps")
    )


def observations(logs: DataFrame, width: int, max_rows: int | None = None) -> DataFrame:
    """Recorded observations; rows of another width stop the job. ``max_rows`` is the sampling operator."""
    o = logs.select("run_id", "eval_idx", F.explode("episodes").alias("e")).select(
        "run_id", "eval_idx", F.col("e.episode_idx").alias("episode_idx"), F.posexplode("e.obs_history").alias("step", "obs")
    )
    wrong = F.raise_error(F.concat(F.lit("observation width "), F.size("obs").cast("string"), F.lit(f", expected {width}")))
    o = o.withColumn("obs", F.when(F.size("obs") == width, F.col("obs")).otherwise(wrong.cast("array<double>")))
    if max_rows is None:
        return o
    return o.orderBy("run_id", "eval_idx", "episode_idx", "step").limit(max_rows)


def read_rewards(spark: SparkSession, path, multiline: bool = True, check: bool = True) -> DataFrame:
    """Reward files to rows ``(source, policy, seed, episode, reward, length)``.

    A file without rewards is an error. Lengths are looked up by place: a file without
    them, or with fewer of them, has null lengths. Long runs are split over files, each
    with the number of its ``first_episode``; without one, episodes count from 0.
    """
    files = _read(spark, path, REWARDS, multiline)
    if check:
        empty = files.where(F.col(CORRUPT).isNotNull() | F.coalesce(F.size("rewards") <= 0, F.lit(True))).select("source").limit(5).collect()
        if empty:
            raise ContractError(f"missing or empty rewards in {[r.source for r in empty]}")
    first = F.coalesce("first_episode", F.lit(0)).alias("_first")
    each = files.select("source", "policy", "seed", "episode_lengths", first, F.posexplode("rewards").alias("_place", "reward"))
    return each.select(
        "source", "policy", "seed", (F.col("_first") + F.col("_place")).alias("episode"), "reward",
        F.get("episode_lengths", F.col("_place")).alias("length"),
    )


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Manifest, statistics or bundle as JSON lines."""
    df.write.mode(mode).json(path)
