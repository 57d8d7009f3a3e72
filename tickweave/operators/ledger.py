"""Running account columns over logs whose keys may be of any size.

All of them are running sums, counts, maxima or peaks, so each is one block scan.
Every function takes a table that ``scan.blocked`` has prepared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators.scan import Running, scan


def _log_growth(pnl: Column, weight: float) -> Column:
    factor = 1.0 + pnl * weight
    return F.when(factor > 0, F.ln(factor)).otherwise(
        F.raise_error(F.lit("a loss of the whole value cannot be compounded")).cast("double")
    )


def with_account(
    df: DataFrame, keys, order, pnl: Column, weight: float = 1.0, nav0: float = 1.0, streak: str = "streak"
) -> DataFrame:
    """Compounded value, its peak (from ``nav0`` on), the drawdown from it, and losses since the last gain.

    All in one scan: the value is a running sum of logs, the peak its highest
    point, and the streak the losses so far minus those at the last gain. A result
    of exactly zero leaves the streak alone.
    """
    growth = _log_growth(pnl, weight)
    loss = F.when(pnl < 0, 1).otherwise(0)
    out = scan(
        df, keys, order,
        Running("_log", "sum", growth),
        Running("_top", "peak", growth, at=F.lit(0.0)),
        Running("_loss", "sum", loss),
        Running("_base", "peak", loss, at=F.when(pnl > 0, 0)),
    )
    out = out.withColumns(
        {
            "nav": F.lit(nav0) * F.exp(F.coalesce("_log", F.lit(0.0))),
            "peak_nav": F.lit(nav0) * F.exp(F.greatest(F.lit(0.0), F.col("_top"))),
            streak: F.col("_loss") - F.coalesce("_base", F.lit(0)),
        }
    ).drop("_log", "_top", "_loss", "_base")
    down = F.greatest((F.col("peak_nav") - F.col("nav")) / F.col("peak_nav"), F.lit(0.0))
    return out.withColumn("drawdown", down)


def with_breach_runs(df: DataFrame, keys, order, value: Column, hi: float, lo: float, k: int) -> DataFrame:
    """``breach`` when the last ``k`` values are all above ``hi`` or all below ``lo``.

    A run is the rows so far minus the rows at the last value outside it.
    """
    over, under = F.coalesce(value > hi, F.lit(False)) & ~F.isnan(value), F.coalesce(value < lo, F.lit(False))
    one, zero = F.lit(1), F.lit(0)
    out = scan(
        df, keys, order,
        Running("_at", "sum", one),
        Running("_hi", "peak", one, at=F.when(~over, 0)),
        Running("_lo", "peak", one, at=F.when(~under, 0)),
    )
    out = out.withColumns(
        {"run_above": F.col("_at") - F.coalesce("_hi", zero), "run_below": F.col("_at") - F.coalesce("_lo", zero)}
    )
    return out.withColumn("breach", (F.col("run_above") >= k) | (F.col("run_below") >= k)).drop("_at", "_hi", "_lo")


def with_new_best(df: DataFrame, keys, order, value: Column, name: str = "new_best") -> DataFrame:
    """Strictly above every earlier value; NaN and missing never count."""
    clean = F.when(~F.isnan(value), value)
    out = scan(df, keys, order, Running("_best", "max", clean, exclusive=True))
    better = clean > F.coalesce("_best", F.lit(float("-inf")))
    return out.withColumn(name, F.coalesce(better, F.lit(False))).drop("_best")


def with_position_state(df: DataFrame, keys, order, unrealised: Column, funding: Column, side: Column) -> DataFrame:
    """Per open position: ticks held, signed funding so far, peak value and give-back from it."""
    paid = funding * side
    out = scan(
        df, keys, order,
        Running("hold_ticks", "count", F.lit(1)),
        Running("cum_funding", "sum", paid),
        Running("_peak", "peak", -paid, at=unrealised),
    )
    # a position starts with a peak of zero
    return out.withColumns(
        {"unrealised": unrealised - F.col("cum_funding"), "peak_unrealised": F.greatest(F.lit(0.0), F.col("_peak"))}
    ).withColumn("give_back", F.col("peak_unrealised") - F.col("unrealised")).drop("_peak")
