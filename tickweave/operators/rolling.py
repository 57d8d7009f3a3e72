"""Backward-looking windows on a grid; a full window is required.

A sliding frame costs time in proportion to its length. A running total minus
the total N rows earlier costs the same for every length. The same difference on
counts tells whether the window is full, and a third on the count of non-zero
inputs makes a quiet window exactly zero.

``keys`` must name groups bounded by the grid, such as ``(symbol, day)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.functions.quotes import positive

# Window lengths in ticks of the 100 ms grid.
FLOW_WINDOWS = {"1s": 10, "5s": 50, "30s": 300}
VOL_WINDOWS = {"5s": 50, "30s": 300, "5min": 3000}
RETURN_TICKS = 10
FUNDING_TICKS = 864_000


def _prefixes(cols, run) -> dict:
    """Running sum, count of present and count of non-zero values of each column."""
    out = {}
    for c in cols:
        out[f"_s_{c}"] = F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(run)
        out[f"_n_{c}"] = F.count(c).over(run)
        out[f"_z_{c}"] = F.count(F.when(F.col(c) != 0, F.lit(1))).over(run)
    return out


def _window_sum(c: str, n: int, w):
    """Sum of the last ``n`` rows from the running values; null unless all ``n`` are present."""

    def diff(col: str):
        return F.col(col) - F.lag(col, n, 0).over(w)

    total = F.when(diff(f"_z_{c}") == 0, F.lit(0.0)).otherwise(diff(f"_s_{c}"))
    return F.when(diff(f"_n_{c}") == n, total)


def _root(total):
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def _trailing(ticks: int, w):
    """Trailing sum of the filled rate from ``_s_rate`` and ``_n_rate``, skipping missing inputs."""
    seen = F.col("_n_rate") - F.lag("_n_rate", ticks, 0).over(w)
    total = F.col("_s_rate") - F.coalesce(F.lag("_s_rate", ticks).over(w), F.lit(0.0))
    return F.when(seen > 0, total)


def rolling_sums(df: DataFrame, specs: dict[str, tuple[str, int]], keys=("symbol", "day"), order="ts_ms") -> DataFrame:
    """``specs`` maps an output name to ``(input column, ticks)``."""
    w = Window.partitionBy(*keys).orderBy(order)
    prefix = _prefixes(sorted({c for c, _ in specs.values()}), w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumns(prefix)
    return out.withColumns({name: _window_sum(c, n, w) for name, (c, n) in specs.items()}).drop(*prefix)


def order_flow(df: DataFrame, windows=FLOW_WINDOWS, flow="signed_volume", keys=("symbol", "day"), order="ts_ms"):
    return rolling_sums(df, {f"ofi_{k}": (flow, n) for k, n in windows.items()}, keys, order)


def _ratio(signed, total):
    """Signed over absolute volume, zero for a silent window, null in the warm-up."""
    return F.when(
        total.isNotNull(), F.when(total > 0, F.coalesce(F.try_divide(signed, total), F.lit(0.0))).otherwise(0.0)
    )


def flow_imbalance(
    df: DataFrame, windows=FLOW_WINDOWS, signed="signed_volume", total="abs_volume", keys=("symbol", "day"), order="ts_ms"
):
    specs = {f"_a_{k}": (signed, n) for k, n in windows.items()} | {f"_b_{k}": (total, n) for k, n in windows.items()}
    out = rolling_sums(df, specs, keys, order)
    return out.withColumns(
        {f"trade_flow_imb_{k}": _ratio(F.col(f"_a_{k}"), F.col(f"_b_{k}")) for k in windows}
    ).drop(*specs)


def flow_features(df: DataFrame, windows=FLOW_WINDOWS, keys=("symbol", "day"), order="ts_ms") -> DataFrame:
    """Order-flow sums and imbalance together, sharing their running totals."""
    specs = {f"ofi_{k}": ("signed_volume", n) for k, n in windows.items()}
    specs |= {f"_b_{k}": ("abs_volume", n) for k, n in windows.items()}
    out = rolling_sums(df, specs, keys, order)
    return out.withColumns(
        {f"trade_flow_imb_{k}": _ratio(F.col(f"ofi_{k}"), F.col(f"_b_{k}")) for k in windows}
    ).drop(*[f"_b_{k}" for k in windows])


def log_return(df: DataFrame, price="micro_price", ticks=RETURN_TICKS, name="micro_price_log_ret", keys=("symbol", "day"), order="ts_ms"):
    w = Window.partitionBy(*keys).orderBy(order)
    p = positive(F.col(price))
    return df.withColumn(name, F.ln(p / F.lag(p, ticks).over(w)))


def realised_vol(df: DataFrame, windows=VOL_WINDOWS, price="micro_price", keys=("symbol", "day"), order="ts_ms"):
    w = Window.partitionBy(*keys).orderBy(order)
    p = positive(F.col(price))
    r = F.ln(p / F.lag(p, 1).over(w))
    out = df.withColumn("_r2", r * r)
    specs = {f"_v_{k}": ("_r2", n) for k, n in windows.items()}
    out = rolling_sums(out, specs, keys, order)
    return out.withColumns({f"realized_vol_{k}": _root(F.col(f"_v_{k}")) for k in windows}).drop("_r2", *specs)


def forward_fill(df: DataFrame, col: str, name: str | None = None, keys=("symbol", "day"), order="ts_ms"):
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name or col, F.last(col, ignorenulls=True).over(run))


def funding_features(df: DataFrame, rate="funding_rate", ticks=FUNDING_TICKS, keys=("symbol", "day"), order="ts_ms"):
    """Filled rate and its trailing sum; missing inputs are skipped, leading ones stay missing."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = forward_fill(df, rate, "funding_8h_rate", keys, order)
    out = out.withColumns({"_s_rate": F.sum("funding_8h_rate").over(run), "_n_rate": F.count("funding_8h_rate").over(run)})
    return out.withColumn("funding_cumulative", _trailing(ticks, w)).drop("_s_rate", "_n_rate")


def all_features(
    df: DataFrame, flow_windows=FLOW_WINDOWS, vol_windows=VOL_WINDOWS, return_ticks=RETURN_TICKS, funding_ticks=FUNDING_TICKS,
    keys=("symbol", "day"), order="ts_ms",
) -> DataFrame:
    """The columns of all functions above in three passes instead of one or two each.

    First what reads inputs, then running values of those, then differences of the
    running values. Every pass is one window over the same sorted partitions.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    p = positive(F.col("micro_price"))
    flows = ["signed_volume", "abs_volume"]
    one = df.withColumns(
        {
            "_p1": F.lag(p, 1).over(w),
            "_pn": F.lag(p, return_ticks).over(w),
            "funding_8h_rate": F.last("funding_rate", ignorenulls=True).over(run),
        }
    ).withColumns({"_r2": F.pow(F.ln(p / F.col("_p1")), F.lit(2.0)), "micro_price_log_ret": F.ln(p / F.col("_pn"))})
    prefix = _prefixes([*flows, "_r2"], run)
    prefix |= {"_s_rate": F.sum("funding_8h_rate").over(run), "_n_rate": F.count("funding_8h_rate").over(run)}
    sums = {f"ofi_{k}": _window_sum("signed_volume", n, w) for k, n in flow_windows.items()}
    sums |= {f"_b_{k}": _window_sum("abs_volume", n, w) for k, n in flow_windows.items()}
    sums |= {f"_v_{k}": _window_sum("_r2", n, w) for k, n in vol_windows.items()}
    sums["funding_cumulative"] = _trailing(funding_ticks, w)
    three = one.withColumns(prefix).withColumns(sums)
    out = {f"trade_flow_imb_{k}": _ratio(F.col(f"ofi_{k}"), F.col(f"_b_{k}")) for k in flow_windows}
    out |= {f"realized_vol_{k}": _root(F.col(f"_v_{k}")) for k in vol_windows}
    work = [c for c in three.columns if c.startswith("_")]
    return three.withColumns(out).drop(*work)


def steps(df: DataFrame, name="step_ms", keys=("symbol", "day"), order="ts_ms", ts="ts_ms") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.col(ts) - F.lag(ts).over(w))
