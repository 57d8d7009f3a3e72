"""Declared table schemas, the feature contract and its checks."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _D, _S, _B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


QUOTES = _struct(ts_ms=_L, bid_px=_D, bid_sz=_D, ask_px=_D, ask_sz=_D)
TRADES = _struct(ts_ms=_L, price=_D, quantity=_D, is_buyer_maker=_B, signed_qty=_D)
DEPTH = _struct(ts_ms=_L, percentage=_D, depth=_D, notional=_D)
FUNDING = _struct(ts_ms=_L, funding_rate=_D)
KLINES = _struct(open_time=_L, close=_D)

# Version, feature names in contract order, state columns.
FEATURE_VERSION = "0.1.0"
MARKET_FEATURES = (
    "ofi_1s", "ofi_5s", "ofi_30s",
    "micro_price_log_ret",
    "log_spread_bps",
    "top1_size_imbalance",
    "bid_depth_pct_neg_0_1", "bid_depth_pct_neg_0_2", "bid_depth_pct_neg_0_5", "bid_depth_pct_neg_1_0",
    "ask_depth_pct_pos_0_1", "ask_depth_pct_pos_0_2", "ask_depth_pct_pos_0_5", "ask_depth_pct_pos_1_0",
    "realized_vol_5s", "realized_vol_30s", "realized_vol_5min",
    "trade_flow_imb_1s", "trade_flow_imb_5s", "trade_flow_imb_30s",
    "funding_cumulative", "funding_8h_rate",
    "hour_of_day_sin", "hour_of_day_cos", "day_of_week_sin", "day_of_week_cos",
)
POSITION_FEATURES = (
    "pos_signed_notional_pct", "pos_unrealized_pnl_pct",
    "pos_hold_ticks_norm", "pos_peak_unrealized_pct",
)
STATE_COLUMNS = ("mid", "bid_px", "ask_px", "abs_volume", "funding_rate")
DEPTH_PREFIXES = ("bid_depth_pct_", "ask_depth_pct_")

# Depth levels in tenths of a percent, and the column of each.
DEPTH_LEVELS = {
    -1: "bid_depth_pct_neg_0_1",
    -2: "bid_depth_pct_neg_0_2",
    -5: "bid_depth_pct_neg_0_5",
    -10: "bid_depth_pct_neg_1_0",
    1: "ask_depth_pct_pos_0_1",
    2: "ask_depth_pct_pos_0_2",
    5: "ask_depth_pct_pos_0_5",
    10: "ask_depth_pct_pos_1_0",
}


class ContractError(ValueError):
    """A table or record does not match what was declared."""


def contract_checksum(version: str = FEATURE_VERSION, names=None) -> str:
    """Checksum of the feature contract; sixteen hex digits."""
    names = names if names is not None else MARKET_FEATURES + POSITION_FEATURES
    return hashlib.sha256("|".join([version, *names]).encode()).hexdigest()[:16]


def content_hash(*cols: Column, length: int = 16) -> Column:
    """The same checksum as a column expression."""
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, length)


def missing_columns(df: DataFrame, required) -> list[str]:
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required, label: str = "table") -> DataFrame:
    absent = missing_columns(df, required)
    if absent:
        raise ContractError(f"{label}: missing columns {absent}")
    return df


def fill_optional(df: DataFrame, required, optional_prefixes=DEPTH_PREFIXES) -> DataFrame:
    """Absent columns whose name has an optional prefix become 0.0; others raise."""
    absent = missing_columns(df, required)
    hard = [c for c in absent if not c.startswith(tuple(optional_prefixes))]
    if hard:
        raise ContractError(f"missing columns {hard}")
    return df.withColumns({c: F.lit(0.0) for c in absent}) if absent else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """The only missing value inside the library is null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    fix = {c: F.when(~F.isnan(c), F.col(c)) for c in floats}
    return df.withColumns(fix) if fix else df


def require_version(df: DataFrame, version: str = FEATURE_VERSION, column: str = "feature_version") -> DataFrame:
    """Every row must carry the current version; reads one row that does not, if any."""
    other = df.where(~F.col(column).eqNullSafe(F.lit(version))).select(column).limit(1).collect()
    if other:
        raise ContractError(f"feature version {other[0][0]!r}, expected {version!r}")
    return df
