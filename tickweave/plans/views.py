"""Tick tables derived from the driver's tables by projection.

The driver ships no order book, so quotes, trades, depth, rates, candles, orders
and logs are expressed over ``events``, ``orders``, ``customer``, ``lineitem``
and ``embeddings``. Every view keeps all rows of its source; defects for the
quality checks are made in values, never by dropping rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_MS = 3_600_000
EIGHT_HOURS_MS = 8 * HOUR_MS
LEVELS = (-10, -5, -2, -1, 1, 2, 5, 10)


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the footer once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumns(
        {
            "ts_ms": F.unix_millis(F.col("ts").cast("timestamp")),
            "day": F.to_date("ts"),
            "symbol": F.col("event_type"),
            "seq": F.col("event_id"),
        }
    )


def _quotes(e: DataFrame, *extra) -> DataFrame:
    return e.select(
        "symbol",
        "day",
        "ts_ms",
        "seq",
        F.col("value").alias("bid_px"),
        (F.col("value") + F.lit(0.01) * (1 + F.col("event_id") % 5)).alias("ask_px"),
        (1 + F.col("user_id") % 7).cast("double").alias("bid_sz"),
        (1 + F.col("event_id") % 4).cast("double").alias("ask_sz"),
        *extra,
    )


def quotes(spark, sf_dir) -> DataFrame:
    return _quotes(events(spark, sf_dir))


def quotes_dirty(spark, sf_dir) -> DataFrame:
    return dirty(quotes(spark, sf_dir))


def dirty(q: DataFrame) -> DataFrame:
    """Crossed books, zero sizes and missing prices at fixed places."""
    return q.withColumn(
        "ask_px", F.when(F.col("seq") % 97 == 0, F.col("bid_px") - F.lit(0.01)).otherwise(F.col("ask_px"))
    ).withColumns(
        {
            "bid_sz": F.when(F.col("seq") % 89 == 0, F.lit(0.0)).otherwise(F.col("bid_sz")),
            "bid_px": F.when(F.col("seq") % 83 != 0, F.col("bid_px")),
        }
    )


def trades(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    qty = (1 + F.col("user_id") % 10).cast("double")
    maker = F.col("event_id") % 2 == 0
    return e.select(
        "symbol",
        "day",
        "ts_ms",
        "seq",
        F.col("value").alias("price"),
        qty.alias("quantity"),
        maker.alias("is_buyer_maker"),
        F.when(maker, -qty).otherwise(qty).alias("signed_qty"),
    )


def trades_dirty(spark, sf_dir) -> DataFrame:
    return trades(spark, sf_dir).withColumn(
        "quantity", F.when(F.col("seq") % 101 == 0, F.lit(0.0)).otherwise(F.col("quantity"))
    )


def depth(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    lvl = F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("level")
    d = e.select("symbol", "day", "ts_ms", "seq", "user_id", "value", lvl)
    shown = (5 + F.abs("level") * (1 + F.col("user_id") % 3)).cast("double")
    size = F.when((F.col("level") != 10) | (F.col("seq") % 20 != 0), shown)
    return d.select(
        "symbol",
        "day",
        "ts_ms",
        "seq",
        (F.col("level") / 10.0).alias("percentage"),
        size.alias("depth"),
        (size * F.col("value")).alias("notional"),
    )


def funding(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    slot = F.col("ts_ms") - F.pmod("ts_ms", F.lit(EIGHT_HOURS_MS))
    return e.groupBy("symbol", slot.alias("ts_ms")).agg(
        ((F.count(F.lit(1)) % 21 - 10) / 100000.0).alias("funding_rate")
    ).withColumn("day", F.to_date(F.timestamp_millis("ts_ms")))


def klines(spark, sf_dir) -> DataFrame:
    q = quotes(spark, sf_dir)
    hour = F.col("ts_ms") - F.pmod("ts_ms", F.lit(HOUR_MS))
    last = q.groupBy("symbol", hour.alias("open_time")).agg(
        F.max_by("bid_px", "seq").alias("b"), F.max_by("ask_px", "seq").alias("a")
    )
    mid = (F.col("b") + F.col("a")) / 2.0
    every6 = (F.col("open_time") / HOUR_MS).cast("long") % 6 == 0
    return last.select(
        "symbol",
        F.to_date(F.timestamp_millis("open_time")).alias("day"),
        "open_time",
        F.when(every6, mid * F.lit(1.0005)).otherwise(mid).alias("close"),
    )


def orders_x(spark, sf_dir) -> DataFrame:
    return trades(spark, sf_dir).select(
        F.col("seq").alias("order_id"),
        "symbol",
        "day",
        "ts_ms",
        F.when(F.col("is_buyer_maker"), -1).otherwise(1).alias("side"),
        (F.col("quantity") * 1000).alias("notional"),
    )


def nav_log(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        "user_id",
        "ts_ms",
        "seq",
        ((F.col("value") - 20.0) / 10000.0).alias("pnl"),
        (F.col("event_type") == "signup").alias("opened"),
        (F.col("event_type") == "error").cast("int").alias("cancels"),
    )


def rewards(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    weak = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")
    return o.select(
        F.col("o_orderpriority").alias("candidate"),
        F.col("o_orderkey").alias("episode"),
        ((F.col("o_totalprice") - 200000.0) / 20000.0).alias("reward"),
        F.when(weak, 1000 + F.col("o_orderkey") % 8000).otherwise(9000).cast("long").alias("length"),
    )


def sweep_runs(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("run"),
        F.col("c_mktsegment").alias("state"),
        F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("metric"),
    )


def train_frame(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("symbol"),
        F.to_date("l_shipdate").alias("day"),
        F.col("l_quantity").cast("double").alias("f_quantity"),
        F.col("l_extendedprice").cast("double").alias("f_price"),
        F.col("l_discount").cast("double").alias("f_discount"),
        F.col("l_tax").cast("double").alias("f_tax"),
        F.lit(7.0).alias("f_constant"),
    )


TRAIN_FEATURES = ("f_quantity", "f_price", "f_discount", "f_tax", "f_constant")


def logits(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("obs_id"), vec.alias("scores"))
