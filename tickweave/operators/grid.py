"""Alignment of raw streams to a uniform time grid.

All streams are labelled with the first tick that may see a row, reduced to one
row per tick before any shuffle (hash aggregates, so hot symbols combine on the
map side), and only then spread over the grid. The dense grid is made by
repeating each reduced row up to the next one, so no grid table is joined.

After the reduction a ``(symbol, day)`` group has at most one row per tick, that
is ``86_400_000 / grid_ms`` rows, whatever the raw volume; the windows below run
on such groups only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.functions import quotes as Q
from tickweave.session import spread

KEYS = ("symbol", "day")
QUOTE_COLS = ("bid_px", "bid_sz", "ask_px", "ask_sz")


def ceil_tick(ts: Column, grid_ms: int) -> Column:
    """First tick at or after ``ts``: the first that may see the row."""
    return ts + F.pmod(-ts, F.lit(grid_ms))


def floor_tick(ts: Column, grid_ms: int) -> Column:
    return ts - F.pmod(ts, F.lit(grid_ms))


def newest_order(ts: Column, seq: Column, grid_ms: int, label: Column) -> Column:
    """``(ts, seq)`` inside one bucket packed into a single long.

    A long keeps ``max_by`` on the hash-aggregate path. The bits left for
    ``seq`` are checked, never cut off.
    """
    bits = 62 - int(grid_ms).bit_length()
    offset = ts - label + F.lit(grid_ms)
    fits = seq.between(0, F.lit((1 << bits) - 1))
    packed = F.shiftleft(offset.cast("long"), bits) + seq
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("seq is outside the packed range")).cast("long"))


def pivot_depth(depth: DataFrame, keys=KEYS, ts="ts_ms", seq="seq", level="percentage", value="depth", scale: int = 10):
    """One wide row per timestamp: the last non-null value of every level.

    Rows of one timestamp and level are ordered by ``seq``; with ``seq=value`` the largest
    value stays. Levels are matched as scaled integers, never as doubles.
    """
    lvl = F.round(F.col(level) * scale).cast("int")
    exact = F.abs(F.col(level) * scale - lvl) < 1e-6
    kept = depth.where(exact & lvl.isin(list(schemas.DEPTH_LEVELS)))
    return kept.groupBy(*keys, ts).agg(
        *[
            F.max_by(value, F.when((lvl == k) & F.col(value).isNotNull(), F.col(seq))).alias(c)
            for k, c in schemas.DEPTH_LEVELS.items()
        ]
    )


def carry_across_days(rates: DataFrame, days: DataFrame, by="symbol", day="day", ts="ts_ms", value="funding_rate"):
    """The last rate of the days before each day, as one row per ``(by, day)``.

    Works on one row per day and symbol, so the window is as long as the calendar.
    """
    daily = rates.groupBy(by, day).agg(F.max_by(value, ts).alias("_last"), F.lit(True).alias("_has"))
    every = days.select(by, day).distinct().join(daily, [by, day], "full")
    before = Window.partitionBy(by).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_has"), F.struct("_last")), ignorenulls=True).over(before)
    return (
        every.withColumn("_carry", last)
        .where(F.col("_carry").isNotNull())
        .select(by, day, F.col("_carry._last").alias(value))
    )


def trade_buckets(trades: DataFrame, grid_ms: int, keys=KEYS, ts="ts_ms", qty="quantity", signed="signed_qty"):
    """Signed volume, volume and count per tick; tick g covers ``[g - grid, g)``."""
    label = floor_tick(F.col(ts), grid_ms) + F.lit(grid_ms)
    return trades.groupBy(*keys, label.alias("tick")).agg(
        F.sum(signed).alias("signed_volume"), F.sum(qty).alias("abs_volume"), F.count(F.lit(1)).alias("trade_count")
    )


def sparse_ticks(quotes, trades=None, depth=None, funding=None, *, grid_ms, keys=KEYS, ts="ts_ms", seq="seq", depth_seq=None):
    """All streams reduced to one row per tick in a single aggregation."""
    keys = list(keys)
    t, s = F.col(ts), F.col(seq)
    up = ceil_tick(t, grid_ms)
    parts = [
        quotes.select(
            *keys, up.alias("tick"), t.alias("_seen"), newest_order(t, s, grid_ms, up).alias("_oq"), *QUOTE_COLS
        )
    ]
    if trades is not None:
        parts.append(
            trades.select(
                *keys,
                (floor_tick(t, grid_ms) + F.lit(grid_ms)).alias("tick"),
                t.alias("_seen"),
                F.col("signed_qty").alias("_signed"),
                F.col("quantity").alias("_qty"),
                F.lit(1).alias("_one"),
            )
        )
    depth_cols = list(schemas.DEPTH_LEVELS.values()) if depth is not None else []
    if depth is not None:
        wide = pivot_depth(depth, keys, ts, depth_seq or seq)
        parts.append(wide.select(*keys, up.alias("tick"), t.alias("_od"), *depth_cols))
    if funding is not None:
        parts.append(funding.select(*keys, up.alias("tick"), t.alias("_of"), "funding_rate"))
        days = quotes.select(*keys)
        carried = carry_across_days(funding, days, by=keys[0], day=keys[1], ts=ts)
        parts.append(
            carried.select(*keys, F.lit(0).cast("long").alias("tick"), F.lit(0).cast("long").alias("_of"), "funding_rate")
        )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)

    aggs = [F.max("_oq").alias("_oq"), F.max("_seen").alias("_seen")]
    aggs += [F.max_by(c, "_oq").alias(c) for c in QUOTE_COLS]
    if trades is not None:
        aggs += [
            F.sum("_signed").alias("signed_volume"),
            F.sum("_qty").alias("abs_volume"),
            F.count("_one").alias("trade_count"),
        ]
    if depth is not None:
        aggs += [F.max("_od").alias("_od"), *[F.max_by(c, "_od").alias(c) for c in depth_cols]]
    if funding is not None:
        aggs += [F.max("_of").alias("_of"), F.max_by("funding_rate", "_of").alias("funding_rate")]
    return rows.groupBy(*keys, "tick").agg(*aggs)


def snapshots(
    quotes, trades=None, depth=None, funding=None, *, grid_ms, keys=KEYS, ts="ts_ms", seq="seq", depth_seq: str | None = None
) -> DataFrame:
    """Uniform grid per ``(symbol, day)`` with as-of quotes, depth, rate and bucketed flow.

    The grid runs from the first tick that sees a quote to the last tick at or
    before the newest quote or trade. The newest row by ``(ts, seq)`` wins; a depth
    level reported twice at one time goes by ``depth_seq``, by default ``seq``. The
    whole wide depth row is carried, so a level missing in the newest row stays
    missing. Absent streams give null depth and rate and zero flow.
    """
    keys = list(keys)
    g = F.lit(grid_ms)
    sparse = sparse_ticks(quotes, trades, depth, funding, grid_ms=grid_ms, keys=keys, ts=ts, seq=seq, depth_seq=depth_seq)
    group = Window.partitionBy(*keys)
    upto = group.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)

    def carried(flag: str, cols):
        return F.last(F.when(F.col(flag).isNotNull(), F.struct(*cols)), ignorenulls=True).over(upto)

    states = {"_q": ("_oq", QUOTE_COLS)}
    if depth is not None:
        states["_d"] = ("_od", tuple(schemas.DEPTH_LEVELS.values()))
    if funding is not None:
        states["_f"] = ("_of", ("funding_rate",))
    flow = ("signed_volume", "abs_volume", "trade_count")

    filled = spread(sparse, *keys).select(
        *keys,
        "tick",
        *[carried(flag, cols).alias(name) for name, (flag, cols) in states.items()],
        *([*flow] if trades is not None else []),
        F.min(F.when(F.col("_oq").isNotNull(), F.col("tick"))).over(group).alias("_first"),
        floor_tick(F.max("_seen").over(group), grid_ms).alias("_end"),
        F.lead("tick").over(group.orderBy("tick")).alias("_next"),
    ).where((F.col("tick") >= F.col("_first")) & (F.col("tick") <= F.col("_end")))

    stop = F.least(F.coalesce(F.col("_next"), F.col("_end") + g), F.col("_end") + g) - g
    dense = filled.withColumn("ts_ms", F.explode(F.sequence(F.col("tick"), stop, g.cast("long"))))

    here = F.col("ts_ms") == F.col("tick")
    zero = F.lit(0.0)
    cols = [F.col(k) for k in keys] + [F.col("ts_ms")]
    cols += [F.col(f"_q.{c}").alias(c) for c in QUOTE_COLS]
    if trades is not None:
        cols += [
            F.when(here, F.coalesce(F.col(c).cast("double"), zero)).otherwise(zero).alias(c) for c in flow[:2]
        ] + [F.when(here, F.coalesce(F.col("trade_count"), F.lit(0))).otherwise(F.lit(0)).cast("long").alias("trade_count")]
    else:
        cols += [zero.alias(c) for c in flow[:2]] + [F.lit(0).cast("long").alias("trade_count")]
    null = F.lit(None).cast("double")
    for c in schemas.DEPTH_LEVELS.values():
        cols.append((F.col(f"_d.{c}") if depth is not None else null).alias(c))
    cols.append((F.col("_f.funding_rate") if funding is not None else null).alias("funding_rate"))

    out = Q.with_quote_features(dense.select(*cols))
    return out.dropna(subset=["bid_px", "ask_px", "mid"])
