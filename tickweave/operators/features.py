"""Snapshots to the feature table, in the order of the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.functions.quotes import calendar_encoding
from tickweave.operators import rolling

# A row with any of these missing is still warming up.
WARMUP_COLUMNS = (
    "ofi_1s", "ofi_5s", "ofi_30s", "micro_price_log_ret",
    "realized_vol_5s", "realized_vol_30s", "realized_vol_5min",
    "trade_flow_imb_1s", "trade_flow_imb_5s", "trade_flow_imb_30s",
)


def build_features(
    snaps: DataFrame,
    flow_windows=rolling.FLOW_WINDOWS,
    vol_windows=rolling.VOL_WINDOWS,
    return_ticks: int = rolling.RETURN_TICKS,
    funding_ticks: int = rolling.FUNDING_TICKS,
    keys=("symbol", "day"),
    dtype: str = "float",
) -> DataFrame:
    """All windows share one partitioning and one order, so the plan has one sort.

    Window lengths are parameters; names stay those of the contract. Depth and
    rate may stay missing; only rolling columns drop a row.
    """
    schemas.require_columns(snaps, [*keys, "ts_ms", "signed_volume", "abs_volume", "micro_price"], "snapshots")
    if "funding_rate" not in snaps.columns:
        snaps = snaps.withColumn("funding_rate", F.lit(None).cast("double"))
    df = rolling.all_features(snaps, flow_windows, vol_windows, return_ticks, funding_ticks, keys)
    df = df.withColumns(calendar_encoding(F.col("ts_ms")))
    df = schemas.fill_optional(df, schemas.MARKET_FEATURES)
    df = df.dropna(subset=list(WARMUP_COLUMNS))
    state = [c for c in schemas.STATE_COLUMNS if c in snaps.columns]
    return df.select(
        *keys,
        "ts_ms",
        *[F.col(c).cast(dtype).alias(c) for c in (*schemas.MARKET_FEATURES, *state)],
        F.lit(schemas.FEATURE_VERSION).alias("feature_version"),
    )
