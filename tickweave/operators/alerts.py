"""Risk thresholds as columns: price moves, account limits, outflows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.operators.orders import day_table
from tickweave.operators.scan import Running, scan
from tickweave.session import materialise

# Thresholds and cooldowns.
JUMP, JUMP_MS = 0.01, 1_000
CRASH, CRASH_MS, CRASH_COOLDOWN_MS = 0.03, 60_000, 3_600_000
LOSSES, LOSS_COOLDOWN_MS = 5, 1_800_000
TRAILING_DRAWDOWN = 0.08
OUTFLOW, DAY_MS = 0.20, 86_400_000
FUNDING = 0.0005
NOTIONAL_SHARE, LEVERAGE = 0.30, 6.0


def price_alerts(
    snaps: DataFrame, grid_ms: int, jump=JUMP, jump_ms=JUMP_MS, crash=CRASH, crash_ms=CRASH_MS, cooldown_ms=CRASH_COOLDOWN_MS,
    price: str = "mid", keys=("symbol", "day"), order="ts_ms",
) -> DataFrame:
    """``price_jump``, ``crash``, and ``blocked`` while the last crash is within the cooldown. For grid data.

    Midnight is no border. A day borrows the last rows before it, as many as the longer move
    looks back over, and the last crash is carried from day to day, one row each.
    """
    sym, day = keys
    back = max(jump_ms // grid_ms, crash_ms // grid_ms, 1)
    days = day_table(snaps, keys, order)
    w = Window.partitionBy(*keys).orderBy(order)
    own = snaps.join(days.select(*keys, "_off", "_n"), list(keys))
    own = own.withColumn("_pos", F.col("_off") + F.row_number().over(w) - 1)
    ends = own.where(F.col("_pos") >= F.col("_off") + F.col("_n") - back).select(sym, "_pos", F.col(price).alias("_price"))
    wanted = days.where("_off > 0").select(*keys, F.explode(F.sequence(F.greatest(F.col("_off") - back, F.lit(0)), F.col("_off") - 1)).alias("_pos"))
    borrowed = wanted.join(ends, [sym, "_pos"])
    both = own.drop("_off", "_n").withColumn("_price", F.col(price)).unionByName(borrowed, allowMissingColumns=True)
    by_pos = Window.partitionBy(*keys).orderBy("_pos")

    def move(ms: int) -> Column:
        return F.try_divide(F.col("_price"), F.lag("_price", max(ms // grid_ms, 1)).over(by_pos)) - 1

    out = both.withColumns({"_j": move(jump_ms), "_c": move(crash_ms)}).where(F.col(order).isNotNull())
    out = out.withColumns(
        {"price_jump": F.coalesce(F.abs("_j") > jump, F.lit(False)), "crash": F.coalesce(F.col("_c") <= -crash, F.lit(False))}
    )
    out = materialise(out.select(*snaps.columns, "price_jump", "crash"), "moves")
    ends = out.groupBy(*keys).agg(F.max(F.when(F.col("crash"), F.col(order))).alias("_last"))
    earlier = Window.partitionBy(sym).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, F.max("_last").over(earlier).alias("_before"))
    here = F.max(F.when(F.col("crash"), F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.coalesce(here, F.col("_before"))
    blocked = F.coalesce(F.col(order) - last <= cooldown_ms, F.lit(False))
    return out.join(carried, list(keys)).withColumn("blocked", blocked).drop("_before")


def account_alerts(
    log: DataFrame, keys, order, ts: str = "ts_ms", streak: str = "streak", drawdown: str = "drawdown", losses: int = LOSSES,
    cooldown_ms: int = LOSS_COOLDOWN_MS, trailing: float = TRAILING_DRAWDOWN,
) -> DataFrame:
    """Limits on a blocked account log: a losing run with its cooldown, and the fall from the peak, which latches."""
    hit = F.col(streak) >= losses
    fell = F.col(drawdown) >= trailing
    out = scan(
        log, keys, order,
        Running("_loss_at", "max", F.when(hit, F.col(ts))),
        Running("_fell", "count", F.when(fell, 1)),
    )
    return out.withColumns(
        {
            "loss_pause": F.coalesce(F.col(ts) - F.col("_loss_at") <= cooldown_ms, F.lit(False)),
            "drawdown_stop": F.col("_fell") > 0,
        }
    ).drop("_loss_at", "_fell")


def outflow_alerts(
    flows: DataFrame, by=("account",), amount="amount", value="value", ts="ts_ms", bucket_ms: int = 3_600_000, share: float = OUTFLOW
) -> DataFrame:
    """Outflow over the trailing day against the value at its start, per bucket.

    Flows are reduced to buckets before the window, so it spans hours, not payments.
    """
    slot = F.col(ts) - F.pmod(F.col(ts), F.lit(bucket_ms))
    hourly = flows.groupBy(*by, slot.alias("bucket_ms")).agg(
        F.sum(F.when(F.col(amount) < 0, -F.col(amount)).otherwise(0.0)).alias("outflow"), F.min_by(value, ts).alias("opening")
    )
    day = Window.partitionBy(*by).orderBy("bucket_ms").rangeBetween(-(DAY_MS - bucket_ms), 0)
    out = hourly.withColumns({"outflow_day": F.sum("outflow").over(day), "opening_day": F.first("opening").over(day)})
    return out.withColumn("redemption_pause", F.coalesce(F.try_divide("outflow_day", "opening_day") > share, F.lit(False)))


def exposure_alerts(df: DataFrame, rate: str, side: str, notional: str, nav: str) -> DataFrame:
    """Row-level limits: funding against the position, notional share, and leverage."""
    share = F.try_divide(F.col(notional), F.col(nav))
    return df.withColumns(
        {
            "funding_gate": F.coalesce(F.col(rate) * F.col(side) > FUNDING, F.lit(False)),
            "over_notional": F.coalesce(share > NOTIONAL_SHARE, F.lit(False)),
            "over_leverage": F.coalesce(share > LEVERAGE, F.lit(False)),
        }
    )
