"""Order tables against snapshots: latency, fills, lifetimes, cancellations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.functions import execution as X
from tickweave.operators.grid import ceil_tick
from tickweave.operators.scan import BLOCK, Running, blocked, scan
from tickweave.operators.splits import hash_mod
from tickweave.session import materialise

_NAMES = list(schemas.DEPTH_LEVELS.values())
BID_DEPTH = [c for c in _NAMES if c.startswith("bid")]
ASK_DEPTH = [c for c in _NAMES if c.startswith("ask")]


def draw_latency(order_id: Column, seed: int, lo: int, hi: int) -> Column:
    """Repeatable uniform number of ticks in ``[lo, hi]``."""
    if hi <= 0:
        return F.lit(0)
    lo = max(0, lo)
    return hash_mod(F.lit(max(lo, hi) - lo + 1), F.lit(seed), order_id) + lo


def schedule(orders: DataFrame, grid_ms: int, seed: int = 0, cfg: X.CostConfig = X.CostConfig(), ts="ts_ms") -> DataFrame:
    """Issue tick (first tick at or after the order) and execution tick."""
    issue = ceil_tick(F.col(ts), grid_ms)
    lat = draw_latency(F.col("order_id"), seed, cfg.latency_min, cfg.latency_max)
    return orders.withColumns({"issue_tick": issue, "latency": lat}).withColumn(
        "execute_tick", F.col("issue_tick") + F.col("latency") * grid_ms
    )


def day_table(snaps: DataFrame, keys=("symbol", "day"), order="ts_ms") -> DataFrame:
    """First and last tick and number of rows of every day, and the rows of its slab before it. Written, so it is read cheaply."""
    sym, day = keys
    days = snaps.groupBy(*keys).agg(F.min(order).alias("_first"), F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(sym).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return materialise(days.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))), "days")


def with_ahead(snaps: DataFrame, cols, k: int, keys=("symbol", "day"), order="ts_ms", days: DataFrame | None = None) -> DataFrame:
    """Each snapshot with its position ``_pos`` in the slab of its symbol and ``_ahead``: its next ``k`` rows, nearest first.

    Midnight is no border: a day borrows the first rows after it, ``k`` at most, so the
    window stays within one day. Past the end of the slab the entries are null.
    """
    sym, day = keys
    days = day_table(snaps, keys, order) if days is None else days
    w = Window.partitionBy(*keys).orderBy(order)
    row = F.struct(order, *cols).alias("_row")
    own = snaps.join(days.select(*keys, "_off"), list(keys)).withColumn("_pos", F.col("_off") + F.row_number().over(w) - 1)
    heads = own.where(F.col("_pos") < F.col("_off") + k).select(sym, "_pos", row)
    end = F.col("_off") + F.col("_n")
    wanted = days.select(*keys, F.explode(F.sequence(end, end + k - 1)).alias("_pos"))
    borrowed = wanted.join(heads, [sym, "_pos"])
    own = own.drop("_off").withColumn("_row", row)
    both = own.unionByName(borrowed, allowMissingColumns=True).withColumn("_own", F.col(order).isNotNull())
    by_pos = Window.partitionBy(*keys).orderBy("_pos")
    out = both.withColumn("_ahead", F.array(*[F.lead("_row", i).over(by_pos) for i in range(1, k + 1)]))
    return out.where("_own").drop("_own", "_row")


def lookup(orders: DataFrame, snaps: DataFrame, grid_ms: int, keys=("symbol", "day"), extra=()) -> DataFrame:
    """Orders with the row of their execution and the prices of the row after it; ``status`` is ``filled`` or ``unfilled``.

    An order counts rows along the slab of its symbol: it is issued at the first tick at or
    after it, on a later day if need be, and executed ``latency`` rows later. An equi-join on
    the position finds the row. An order without a row, or without one after it, stays and
    is unfilled; ``execute_tick`` is then null or that of the last row. Snapshots are a
    grid without gaps within a day.
    """
    sym, day = keys
    cols = list(dict.fromkeys(["bid_px", "ask_px", "mid", "funding_rate", *extra]))
    days = day_table(snaps, keys)
    rows = with_ahead(snaps, cols, 1, keys, days=days)
    nxt = F.col("_ahead")[0]
    rows = rows.select(
        sym, "_pos", F.col("ts_ms").alias("execute_tick"), F.col("mid").alias("row_mid"), F.col("abs_volume").alias("row_volume"),
        nxt["ts_ms"].alias("next_tick"), *[nxt[c].alias(f"next_{c}") for c in cols],
    )
    # a day without snapshots has no rows of its own; its orders wait for the next one
    gone = orders.select(*keys).distinct().join(days, list(keys), "left_anti").withColumn("_n", F.lit(0).cast("long"))
    before = Window.partitionBy(sym).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    every = days.drop("_off").unionByName(gone, allowMissingColumns=True)
    every = every.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    tick = F.col("issue_tick")
    inside = F.when((F.col("_n") == 0) | (tick <= F.col("_first")), 0).when(tick > F.col("_last"), F.col("_n"))
    inside = inside.otherwise(F.floor((tick - F.col("_first")) / grid_ms))
    placed = orders.drop("execute_tick").join(every, list(keys))
    placed = placed.withColumn("_pos", F.col("_off") + inside + F.col("latency")).drop("_first", "_last", "_n", "_off")
    status = F.when(F.col("next_mid").isNotNull(), "filled").otherwise("unfilled")
    return placed.join(rows, [sym, "_pos"], "left").withColumn("status", status).drop("_pos")


def market_fills(
    orders: DataFrame, snaps: DataFrame, grid_ms: int, cfg: X.CostConfig = X.CostConfig(), keys=("symbol", "day")
) -> DataFrame:
    """Fill price, fee and slippage of scheduled market orders. Depth is taken from the next row as well.

    The fill of an unfilled order is null.
    """
    found = lookup(orders, snaps, grid_ms, keys, [*ASK_DEPTH, *BID_DEPTH])
    found = X.with_tick_size(found, cfg.tick_sizes, cfg.default_tick_size)
    found = X.with_market_fill(
        found.withColumn("_volume", F.col("row_volume") * F.col("row_mid")), "fill", "side", "notional", "next_mid", "next_bid_px",
        "next_ask_px", F.col("_volume"), "tick_size", [f"next_{c}" for c in ASK_DEPTH], [f"next_{c}" for c in BID_DEPTH], cfg,
    ).drop("_volume")
    return found.withColumn("fill", F.when(F.col("status") == "filled", F.col("fill")))


def limit_lifetimes(orders: DataFrame, snaps: DataFrame, max_age: int = 10, keys=("symbol", "day"), resting=None):
    """Posted orders with ``fill_tick`` (null when cancelled) and ``age`` in rows.

    ``orders`` has ``order_id``, the keys of the row it is posted at, ``side``, ``post_tick``
    and ``post_price``. Every snapshot carries its next ``max_age`` rows, across midnight, so
    an order is joined once and takes the first of them that trades through.
    """
    rows = with_ahead(snaps, ["bid_px", "ask_px", "abs_volume"], max_age, keys)
    rows = rows.select(*keys, F.col("ts_ms").alias("post_tick"), "_ahead")
    seen = orders.join(rows, [*keys, "post_tick"], "left")
    found = []
    for i in range(max_age):
        at = F.col("_ahead")[i]
        hit = X.trade_through(
            F.col("side"), F.col("post_price"), at["bid_px"], at["ask_px"], at["abs_volume"], F.col(resting) if resting else None
        )
        found.append(F.when(hit, F.struct(at["ts_ms"].alias("tick"), F.lit(i + 1).alias("age"))))
    first = seen.withColumn("_hit", F.coalesce(*found))
    return first.withColumns(
        {
            "fill_tick": F.col("_hit.tick"),
            "filled": F.col("_hit").isNotNull(),
            "age": F.when(F.col("post_tick").isNotNull(), F.coalesce("_hit.age", F.lit(max_age))),
        }
    ).drop("_hit", "_ahead")


def superseded(orders: DataFrame, keys=("symbol",), order=("issue_tick", "order_id"), blocks: int | None = None) -> DataFrame:
    """Market orders with the number of orders still in flight that each one cancels.

    Orders wait in one queue, so an order leaves no earlier than those ahead of
    it; its effective tick is the running maximum since the last market order
    cleared the queue. It is cancelled when the next market order comes no later.
    Needs ``is_market``, ``issue_tick`` and ``execute_tick``.
    """
    keys, order = list(keys), list(order)
    rows = blocked(orders, keys, order, blocks, "orders")
    mkt = F.col("is_market")
    turn = materialise(scan(rows, keys, order, Running("_turn", "count", F.when(mkt, 1))), "turns")
    held = scan(turn, [*keys, "_turn"], order, Running("_leaves", "max", F.col("execute_tick"))).drop(BLOCK)
    clears = turn.where(mkt).select(
        *keys, (F.col("_turn") - 1).alias("_turn"), F.col("issue_tick").alias("cleared_tick"), F.col("order_id").alias("cleared_by")
    )
    # one clearing row per turn; the turns are reduced on the map side first
    leaves = held.groupBy(*keys, "_turn", "_leaves").agg(F.count(F.lit(1)).alias("_n"))
    hit = leaves.join(clears, [*keys, "_turn"]).where(F.col("_leaves") >= F.col("cleared_tick"))
    counts = hit.groupBy(F.col("cleared_by").alias("order_id")).agg(F.sum("_n").alias("n_cancelled"))
    return turn.where(mkt).drop(BLOCK, "_turn").join(counts, "order_id", "left").withColumn(
        "n_cancelled", F.coalesce("n_cancelled", F.lit(0))
    )


def position_pnl(
    legs: DataFrame, keys, leverage: float = 6.0, include_slippage: bool = True, zero_entry_is_price: bool = False
) -> DataFrame:
    """Open and close legs of each position folded into one row with its pnl terms and ``status``.

    A position without one of its legs stays, as ``open`` or ``orphan``, with null pnl.
    ``legs`` has ``is_open``, ``side``, ``price``, ``fee``, ``slippage`` and
    ``funding``. Slippage is its own column because a fill price may already hold it.
    """
    opened, closed = F.col("is_open"), ~F.col("is_open")

    def leg(cond, c):
        return F.max(F.when(cond, F.col(c)))

    rows = legs.groupBy(*keys).agg(
        leg(opened, "side").alias("side"), leg(opened, "price").alias("entry_price"), leg(closed, "price").alias("exit_price"),
        F.sum("fee").alias("fees"), F.sum("slippage").alias("slippage"), F.sum("funding").alias("funding"),
    )
    status = F.when(F.col("entry_price").isNull(), "orphan").when(F.col("exit_price").isNull(), "open").otherwise("closed")
    rows = rows.withColumn("status", status)
    gross = X.gross_pnl(F.col("side"), F.col("exit_price"), F.col("entry_price"), leverage, zero_entry_is_price)
    slip = F.col("slippage") if include_slippage else F.lit(0.0)
    return rows.withColumn("gross_pnl", gross).withColumn(
        "net_pnl", X.net_pnl(F.col("gross_pnl"), F.col("fees"), slip, F.col("funding"))
    )
