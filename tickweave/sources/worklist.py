"""What has to be done: the day plan minus what already exists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Assets, their symbols, and the first listed day.
ASSETS = {"BTC": "BTCUSDT", "ETH": "ETHUSDT", "SOL": "SOLUSDT"}
LISTED = {"BTCUSDT": "2019-09-10", "ETHUSDT": "2019-11-27", "SOLUSDT": "2021-07-12"}


def asset_dimension(spark: SparkSession, assets: dict = ASSETS, listed: dict = LISTED) -> DataFrame:
    rows = [(a, s, date.fromisoformat(listed[s]) if s in listed else None) for a, s in assets.items()]
    return spark.createDataFrame(rows, "asset string, symbol string, listed date")


def day_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All days from ``start`` to ``end``, both included."""
    if date.fromisoformat(end) < date.fromisoformat(start):
        raise ValueError(f"end {end} is before start {start}")
    one = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    return one.select(F.explode(F.sequence("a", "b")).alias("day"))


def task_plan(symbols: DataFrame, streams: list[str], start: str, end: str, listed: DataFrame | None = None) -> DataFrame:
    """``(symbol, day, stream)`` from each symbol's first listed day on.

    Days and streams are unrolled per symbol row, so nothing is joined pairwise.
    An unknown symbol keeps every day.
    """
    if date.fromisoformat(end) < date.fromisoformat(start):
        raise ValueError(f"end {end} is before start {start}")
    base = symbols.select("symbol").distinct()
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    if listed is not None:
        base = base.join(listed.select("symbol", "listed"), "symbol", "left")
        first = F.greatest(first, F.coalesce("listed", first))
    days = base.withColumn("_from", first).where(F.col("_from") <= last)
    return days.select("symbol", F.explode(F.sequence("_from", last)).alias("day")).select(
        "symbol", "day", F.explode(F.array(*[F.lit(s) for s in streams])).alias("stream")
    )


def pending(plan: DataFrame, done: DataFrame, overwrite: bool = False, keys=("symbol", "day", "stream")) -> DataFrame:
    """Planned work without an existing result."""
    if overwrite:
        return plan
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")


def summarise(results: DataFrame) -> DataFrame:
    """Outcome counts by status."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def require_ok(results: DataFrame) -> None:
    """Fail the job when any task failed; names at most five."""
    bad = results.where(F.col("status") != "ok")
    if n := bad.count():
        raise RuntimeError(f"{n} tasks failed, such as {[tuple(r) for r in bad.limit(5).collect()]}")
