"""Columns computed from one quote or trade row, and calendar encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2.0


def log_spread_bps(bid: Column, ask: Column, m: Column) -> Column:
    """Log relative spread in basis points; a crossed book counts as zero width."""
    return F.when(m > 0, F.log1p(F.greatest(ask - bid, F.lit(0.0)) / m) * 10_000).otherwise(0.0)


def size_imbalance(bid_sz: Column, ask_sz: Column) -> Column:
    return F.coalesce(F.try_divide(bid_sz - ask_sz, bid_sz + ask_sz), F.lit(0.0))


def micro_price(bid: Column, bid_sz: Column, ask: Column, ask_sz: Column, m: Column) -> Column:
    """Mid weighted by the opposite size; plain mid when no size is shown."""
    total = bid_sz + ask_sz
    return F.when(total > 0, F.try_divide(bid * ask_sz + ask * bid_sz, total)).otherwise(m)


def with_quote_features(df: DataFrame) -> DataFrame:
    b, a, bs, asz = (F.col(c) for c in ("bid_px", "ask_px", "bid_sz", "ask_sz"))
    df = df.withColumn("mid", mid(b, a))
    m = F.col("mid")
    return df.withColumns(
        {
            "micro_price": micro_price(b, bs, a, asz, m),
            "log_spread_bps": log_spread_bps(b, a, m),
            "top1_size_imbalance": size_imbalance(bs, asz),
        }
    )


def signed_quantity(qty: Column, is_buyer_maker: Column) -> Column:
    """Positive when the taker bought."""
    return F.when(is_buyer_maker, -qty).otherwise(qty)


def positive(price: Column) -> Column:
    """Prices at or below zero count as missing."""
    return F.when(price > 0, price)


def finite_or_zero(x: Column) -> Column:
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(ok, x).otherwise(F.lit(0.0))


def is_invalid(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def clip(x: Column, bound: float) -> Column:
    """Symmetric clip; a bound at or below zero switches it off. Null stays null."""
    if bound <= 0:
        return x
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-float(bound))), F.lit(float(bound))))


def zscore(x: Column, mean: Column, std: Column, bound: float = 0.0) -> Column:
    return clip((x - mean) / std, bound)


def calendar_encoding(ts_ms: Column) -> dict[str, Column]:
    """Hour (minutes counted, seconds not) and weekday (Monday 0) on the unit circle, in UTC."""
    ts = F.timestamp_millis(ts_ms)
    hour = F.hour(ts) + F.minute(ts) / 60.0
    dow = F.weekday(ts)
    turn = 2.0 * math.pi
    return {
        "hour_of_day_sin": F.sin(F.lit(turn) * hour / 24.0),
        "hour_of_day_cos": F.cos(F.lit(turn) * hour / 24.0),
        "day_of_week_sin": F.sin(F.lit(turn) * dow / 7.0),
        "day_of_week_cos": F.cos(F.lit(turn) * dow / 7.0),
    }
