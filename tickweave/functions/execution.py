"""Execution-cost columns of one order against one book row.

``side`` is +1 for buys and -1 for sells. Depth columns are cumulative base sizes
at growing distance from mid.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Distance of the depth levels from mid, in percent, and default tick sizes.
LEVELS_PCT = (0.1, 0.2, 0.5, 1.0)
TICK_SIZES = {"BTCUSDT": 0.5, "ETHUSDT": 0.05, "SOLUSDT": 0.01}


@dataclass(frozen=True)
class CostConfig:
    """Defaults of the cost model (fixed values)."""

    fee_taker_bps: float = 3.5
    fee_maker_bps: float = 1.0
    slippage_c: float = 0.001
    slippage_noise: float = 0.0
    walk_book: bool = True
    zero_depth_is_book: bool = False
    zero_top_is_price: bool = False
    trade_through: bool = True
    limit_threshold_bps: float = 1.0
    limit_max_age: int = 10
    funding_interval_ticks: int = 288_000
    maintenance_margin: float = 0.03
    leverage: float = 6.0
    latency_min: int = 1
    latency_max: int = 5
    default_tick_size: float = 0.0
    tick_sizes: dict = field(default_factory=lambda: dict(TICK_SIZES))


def round_to_tick(price: Column, tick: Column, how: str | None = None) -> Column:
    """``up``, ``down`` or nearest (halves to even); a tick at or below zero changes nothing."""
    n = F.try_divide(price, F.when(tick > 0, tick))
    steps = {"up": F.ceil, "down": F.floor}.get(how, F.rint)(n)
    return F.when(tick > 0, steps.cast("double") * tick).otherwise(price)


def round_adverse(price: Column, tick: Column, side: Column) -> Column:
    """Against the order: buys up, sells down."""
    return F.when(side > 0, round_to_tick(price, tick, "up")).otherwise(round_to_tick(price, tick, "down"))


def with_tick_size(df: DataFrame, sizes: dict | DataFrame, default: float = 0.0, by: str = "symbol") -> DataFrame:
    """Tick size per symbol. A dict is an argument list and is broadcast; a table joins by its real size."""
    if isinstance(sizes, dict):
        if not sizes:
            return df.withColumn("tick_size", F.lit(float(default)))
        pairs = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(float(v)))])
        return df.withColumn("tick_size", F.coalesce(pairs[F.col(by)], F.lit(float(default))))
    return df.join(sizes.select(by, "tick_size"), by, "left").withColumn(
        "tick_size", F.coalesce("tick_size", F.lit(float(default)))
    )


def walk_book(
    side: Column, notional: Column, mid: Column, top: Column, depth: list[Column], levels=LEVELS_PCT, zero_top_is_price: bool = False
) -> Column:
    """Struct ``(price, slippage, exhausted)`` of filling ``notional`` through the levels.

    Bucket by bucket, so that rounding errors are those of the steps: each takes at most its
    own size off what is left. An order without a best price above zero is not walked;
    with ``zero_top_is_price`` a best price of zero is one like any other.
    """
    target = notional / mid
    edges = [mid] + [mid * (1 + side * (p / 100.0)) for p in levels]
    zero = F.lit(0.0)
    sizes = [F.greatest(depth[0], zero)] + [F.greatest(b - a, zero) for a, b in zip(depth, depth[1:])]
    spent, rest = zero, target
    for i, size in enumerate(sizes):
        near = F.when(side > 0, F.greatest(edges[i], top)).otherwise(F.least(edges[i], top))
        spent = spent + F.least(rest, size) * (near + edges[i + 1]) * 0.5
        # the same as rest less the smaller of both, but names rest once
        rest = F.greatest(rest - size, zero)
    vwap = (spent + rest * edges[-1]) / target
    valid = (notional > 0) & (mid > 0) & (top >= 0 if zero_top_is_price else top > 0)
    return F.when(
        valid,
        F.struct(
            vwap.alias("price"),
            F.greatest(side * (vwap - mid) / mid, zero).alias("slippage"),
            (rest > 0).alias("exhausted"),
        ),
    ).otherwise(F.struct(top.alias("price"), zero.alias("slippage"), F.lit(False).alias("exhausted")))


def sqrt_impact(notional: Column, volume: Column, c: float = 0.001, noise: float = 0.0, seed: int = 0) -> Column:
    """Impact grows with the root of participation; zero without volume."""
    base = F.when(volume > 0, F.lit(c) * F.sqrt(F.greatest(F.try_divide(notional, volume), F.lit(0.0)))).otherwise(0.0)
    if noise:
        base = F.greatest(base * (1 + F.lit(noise) * F.randn(seed)), F.lit(0.0))
    return base


def market_fill(
    side: Column, notional: Column, mid: Column, bid: Column, ask: Column, volume: Column, tick: Column,
    ask_depth: list[Column], bid_depth: list[Column], cfg: CostConfig = CostConfig(),
) -> Column:
    """Struct ``(price, fee, slippage, used_book)``: through the book, else by impact bounded by mid."""
    top = F.when(side > 0, ask).otherwise(bid)
    depth = [F.when(side > 0, a).otherwise(b) for a, b in zip(ask_depth, bid_depth)]
    shown = reduce(lambda a, b: a & b, [F.coalesce(x >= 0, F.lit(False)) for x in depth])
    if not cfg.zero_depth_is_book:
        shown = shown & reduce(lambda a, b: a | b, [F.coalesce(x > 0, F.lit(False)) for x in depth])
    use = shown & F.lit(cfg.walk_book)
    book = walk_book(side, notional, mid, top, depth, zero_top_is_price=cfg.zero_top_is_price)
    slip = sqrt_impact(notional, volume, cfg.slippage_c, cfg.slippage_noise)
    moved = top * (1 + side * slip)
    bounded = F.when(side > 0, F.greatest(moved, mid)).otherwise(F.least(moved, mid))
    price = F.when(use, book["price"]).otherwise(bounded)
    return F.struct(
        round_adverse(price, tick, side).alias("price"),
        F.lit(cfg.fee_taker_bps / 10_000.0).alias("fee"),
        F.when(use, book["slippage"]).otherwise(slip).alias("slippage"),
        use.alias("used_book"),
    )


def with_market_fill(
    df: DataFrame, name: str, side: str, notional: str, mid: str, bid: str, ask: str, volume: Column, tick: str, ask_depth: list[str],
    bid_depth: list[str], cfg: CostConfig = CostConfig(),
) -> DataFrame:
    """``market_fill`` as the column ``name``, its shared steps as columns of their own.

    As one expression the side's depth and the walk through it stand in the plan wherever they
    are used, which is more code than the JVM compiles. The planner doesn't merge projections
    whose results are used more than once, so each step is computed once.
    """
    c, buy = F.col, F.col(side) > 0
    depth = [f"_depth_{i}" for i in range(len(ask_depth))]
    sided = {d: F.when(buy, c(a)).otherwise(c(b)) for d, a, b in zip(depth, ask_depth, bid_depth, strict=True)}
    df = df.withColumns(sided | {"_top": F.when(buy, c(ask)).otherwise(c(bid))})
    shown = F.least(*[F.coalesce(c(d), F.lit(-1.0)) for d in depth]) >= 0
    if not cfg.zero_depth_is_book:
        shown = shown & (F.greatest(*[c(d) for d in depth]) > 0)
    df = df.withColumns(
        {
            "_use": F.coalesce(shown, F.lit(False)) & F.lit(cfg.walk_book),
            "_book": walk_book(
                c(side), c(notional), c(mid), c("_top"), [c(d) for d in depth], zero_top_is_price=cfg.zero_top_is_price
            ),
            "_slip": sqrt_impact(c(notional), volume, cfg.slippage_c, cfg.slippage_noise),
        }
    )
    df = df.withColumn("_moved", c("_top") * (1 + c(side) * c("_slip")))
    bounded = F.when(buy, F.greatest(c("_moved"), c(mid))).otherwise(F.least(c("_moved"), c(mid)))
    df = df.withColumn("_price", F.when(c("_use"), c("_book")["price"]).otherwise(bounded))
    fill = F.struct(
        round_adverse(c("_price"), c(tick), c(side)).alias("price"),
        F.lit(cfg.fee_taker_bps / 10_000.0).alias("fee"),
        F.when(c("_use"), c("_book")["slippage"]).otherwise(c("_slip")).alias("slippage"),
        c("_use").alias("used_book"),
    )
    return df.withColumn(name, fill).drop(*depth, "_top", "_use", "_book", "_slip", "_moved", "_price")


def trade_through(side: Column, post: Column, bid: Column, ask: Column, volume: Column | None = None, resting: Column | None = None):
    """A posted price is hit when the other side trades through it; the queue test is optional."""
    hit = F.when(side > 0, ask <= post).otherwise(bid >= post)
    if volume is not None and resting is not None:
        hit = hit & (resting.isNull() | volume.isNull() | (volume > resting))
    return F.coalesce(hit, F.lit(False))


def mid_move_fill(side: Column, prev_mid: Column, next_mid: Column, threshold_bps: float = 1.0) -> Column:
    """The older test: mid moved through by at least the threshold."""
    moved = side * (prev_mid - next_mid) / F.when(prev_mid > 0, prev_mid) * 10_000.0
    return F.coalesce(moved >= threshold_bps, F.lit(False))


def funding_per_tick(rate: Column, interval_ticks: int) -> Column:
    from tickweave.functions.quotes import is_invalid

    if interval_ticks <= 0:
        return F.lit(0.0)
    return F.when(is_invalid(rate), 0.0).otherwise(rate / float(interval_ticks))


def is_liquidated(pnl_on_notional: Column, leverage: float, margin: float) -> Column:
    if leverage <= 0:
        return F.lit(False)
    return pnl_on_notional <= F.lit(margin - 1.0 / leverage)


def gross_pnl(side: Column, mark: Column, entry: Column, leverage: float, zero_entry_is_price: bool = False) -> Column:
    """Zero without an entry price above zero; with ``zero_entry_is_price`` the division by it, infinite or NaN."""
    move = side * (mark - entry)
    if zero_entry_is_price:
        return F.when(entry == 0, move * F.lit(float("inf"))).otherwise(F.try_divide(move, entry) * float(leverage))
    return F.when(entry > 0, move / entry * float(leverage)).otherwise(0.0)


def net_pnl(gross: Column, fees: Column, slippage: Column, funding: Column) -> Column:
    return gross - fees - slippage - funding
