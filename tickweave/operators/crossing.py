"""First crossing of a price at any distance, by minima and maxima of blocks.

Rows of a slab are summed up in blocks of ``fan`` rows, and those in blocks of ``fan``
blocks: the lowest ask and the highest bid of each. A resting order looks at the rest of
its own block, then at the later blocks beside it, then at the later blocks above; the first
one that can fill it is opened again, down to the row. So an order meets at most five
blocks, and the plan is the same for every distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.operators.orders import day_table
from tickweave.session import materialise

FAN = 256


def with_slab_positions(snaps: DataFrame, keys=("symbol", "day"), order="ts_ms") -> DataFrame:
    """``_pos``, a row's position in the slab of its symbol: the offset of its day and its place in it."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    days = day_table(snaps, keys, order).select(*keys, "_off")
    return snaps.join(days, list(keys)).withColumn("_pos", F.col("_off") + place).drop("_off")


def _blocks(cells: DataFrame, by: list[str], fan: int) -> DataFrame:
    """``by, at, lo, hi, cells`` of blocks of ``fan`` cells ``at, lo, hi``; a block holds at most ``fan`` of them."""
    return cells.groupBy(*by, F.floor(F.col("at") / fan).alias("block")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("at", "lo", "hi"))).alias("cells")
    ).withColumnRenamed("block", "at")


def _first(after: Column | None, side: Column, price: Column) -> Column:
    """Place of the first cell past ``after`` that can fill the order, null without one."""

    def fills(cell):
        hit = F.when(side > 0, cell["lo"] <= price).otherwise(cell["hi"] >= price)
        return hit if after is None else hit & (cell["at"] > after)

    return F.get(F.filter("cells", fills), 0)["at"]


def first_crossings(
    orders: DataFrame, rows: DataFrame, by=("symbol",), pos="_pos", side="side", price="price", bid="bid_px", ask="ask_px", fan: int = FAN
) -> DataFrame:
    """``orders`` with ``at``, the first later position whose ask (buys) or bid (sells) reaches the price; null if none does.

    ``rows`` has one row per ``by`` and ``pos``. Orders without a position or price have no
    crossing, and null quotes fill nothing. The top level has a cell per ``fan`` squared rows of a slab.
    """
    by = list(by)
    cells = rows.select(*by, F.col(pos).alias("at"), F.col(ask).alias("lo"), F.col(bid).alias("hi"))
    low = materialise(_blocks(cells, by, fan), "row-blocks")
    high = materialise(_blocks(low.drop("cells"), by, fan), "block-blocks")
    top = high.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "lo", "hi"))).alias("cells"))
    s, p, here = F.col(side), F.col(price), F.col(pos)
    block = F.floor(here / fan)
    above = F.floor(block / fan)

    def look(some: DataFrame, level: DataFrame, key: Column | None, after: Column | None, name: str) -> DataFrame:
        named = level.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *([F.col("at").alias("_at")] if key is not None else []), "cells")
        same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(by)] + ([key == F.col("_at")] if key is not None else [])
        found = some.join(named, reduce(lambda a, b: a & b, same), "left")
        return found.withColumn(name, _first(after, s, p)).drop("_at", "cells", *[f"_k{i}" for i in range(len(by))])

    posted = orders.where(here.isNotNull() & p.isNotNull())
    own = materialise(look(posted, low, block, here, "at"), "own-block")
    beside = materialise(look(own.where("at is null").drop("at"), high, above, block, "_block"), "beside")
    over = materialise(look(beside.where("_block is null").drop("_block"), top, None, above, "_above"), "above")
    down = look(over.where("_above is not null"), high, F.col("_above"), None, "_block").drop("_above")
    late = beside.where("_block is not null").unionByName(down)
    late = look(late, low, F.col("_block"), None, "at").drop("_block")
    none = F.lit(None).cast("long")
    never = over.where("_above is null").drop("_above").withColumn("at", none)
    apart = orders.where(here.isNull() | p.isNull()).withColumn("at", none)
    return own.where("at is not null").unionByName(late).unionByName(never).unionByName(apart)


def crossing_lifetimes(orders: DataFrame, snaps: DataFrame, max_age: int, keys=("symbol", "day"), fan: int = FAN) -> DataFrame:
    """``filled`` and ``age`` in rows of posted orders, for any ``max_age``; the same results as ``limit_lifetimes`` without queues.

    ``orders`` has the keys of the row it is posted at, ``side``, ``post_tick`` and ``post_price``.
    """
    sym = keys[0]
    rows = materialise(with_slab_positions(snaps.select(*keys, "ts_ms", "bid_px", "ask_px"), keys), "slab-rows")
    place = rows.select(*keys, F.col("ts_ms").alias("post_tick"), "_pos")
    # orders without a post tick keep out of the join
    posted = orders.where("post_tick is not null").join(place, [*keys, "post_tick"], "left")
    seen = posted.unionByName(orders.where("post_tick is null"), allowMissingColumns=True)
    found = first_crossings(seen, rows, (sym,), price="post_price", fan=fan)
    age = F.col("at") - F.col("_pos")
    filled = F.coalesce(age <= max_age, F.lit(False))
    out = found.withColumn("filled", filled)
    return out.withColumn(
        "age", F.when(F.col("post_tick").isNotNull(), F.when(F.col("filled"), age).otherwise(max_age)).cast("int")
    ).drop("at", "_pos")
