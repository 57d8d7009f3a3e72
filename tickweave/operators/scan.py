"""Running aggregates over keys of any size.

A plain running window puts one key into one task. Here the rows are range
partitioned on ``(keys, order)`` into blocks of even size, so one key with a
third of the table is spread over a third of the blocks. Each block is scanned
on its own, each block is also reduced to one total per key, and the totals of
the earlier blocks of the same key are added as a carry.

A key needs a carry in every block but its first. Blocks are contiguous in key
order, so a block holds at most one key that began earlier: the carry table has
fewer rows than there are blocks, which is why it may be broadcast.

The block number is fixed by writing the partitioned rows once to the shared
folder; recomputing a sampled range partitioning could move the borders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.session import materialise

BLOCK = "_block"


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, count, max, min, last or peak.

    ``exclusive`` looks at earlier rows only. ``last`` takes the newest non-null
    value; wrap the input in a struct to keep inner nulls. ``peak`` is the highest
    ``at`` plus the running sum of ``value``, over the rows where ``at`` is not
    null; it saves a second scan over the result of a first.
    """

    name: str
    kind: str
    value: Column
    exclusive: bool = False
    at: Column | None = None


def blocked(df: DataFrame, keys, order, blocks: int | None = None, label: str = "blocks") -> DataFrame:
    """Rows range partitioned on ``(*keys, *order)`` and stamped with their block."""
    by = [*keys, *order]
    ranged = df.repartitionByRange(blocks, *by) if blocks else df.repartitionByRange(*by)
    return materialise(ranged.withColumn(BLOCK, F.spark_partition_id()), label)


def _frame_value(r: Running, window) -> Column:
    end = -1 if r.exclusive else 0
    over = window.rowsBetween(Window.unboundedPreceding, end)
    if r.kind == "last":
        return F.last(r.value, ignorenulls=True).over(over)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[r.kind](r.value).over(over)


def _block_total(r: Running, order) -> Column:
    if r.kind == "last":
        newest = F.struct(*[F.when(r.value.isNotNull(), F.col(c)).alias(f"o{i}") for i, c in enumerate(order)])
        return F.max_by(r.value, F.when(r.value.isNotNull(), newest))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[r.kind](r.value)


def _carry(r: Running, window) -> Column:
    col = F.col(f"_t_{r.name}")
    if r.kind == "last":
        return F.last(col, ignorenulls=True).over(window)
    return {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}[r.kind](col).over(window)


def _combine(r: Running) -> Column:
    here, before = F.col(f"_h_{r.name}"), F.col(f"_c_{r.name}")
    if r.kind == "count":
        return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
    if r.kind == "sum":
        return F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before)
    if r.kind == "last":
        return F.coalesce(here, before)
    return {"max": F.greatest, "min": F.least}[r.kind](here, before)


def scan(df: DataFrame, keys, order, *running: Running) -> DataFrame:
    """Add running values to a ``blocked`` table.

    ``order`` are column names that make the order total within ``keys``. Scans
    can be chained: the block column stays, and a later scan may use finer keys
    as long as they grow with the same order. A later scan evaluates the earlier
    one twice, so longer chains should be written out in between.
    """
    keys, order = list(keys), list(order)
    plain, peaks = [r for r in running if r.kind != "peak"], [r for r in running if r.kind == "peak"]
    inner = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)

    sums = {f"_s_{r.name}": F.sum(r.value).over(upto) for r in peaks}
    heights = {r.name: r.at + F.coalesce(F.col(f"_s_{r.name}"), F.lit(0)) for r in peaks}
    local = df.withColumns({**{f"_h_{r.name}": _frame_value(r, inner) for r in plain}, **sums})
    scanned = local.withColumns({f"_h_{n}": F.max(h).over(upto) for n, h in heights.items()}) if peaks else local

    aggs = [_block_total(r, order).alias(f"_t_{r.name}") for r in plain]
    for r in peaks:
        aggs += [F.sum(r.value).alias(f"_ts_{r.name}"), F.max(heights[r.name]).alias(f"_t_{r.name}")]
    totals = (df.withColumns(sums) if peaks else df).groupBy(*keys, BLOCK).agg(*aggs)

    blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns(
        {
            **{f"_c_{r.name}": _carry(r, earlier) for r in plain},
            **{f"_cs_{r.name}": F.coalesce(F.sum(f"_ts_{r.name}").over(earlier), F.lit(0)) for r in peaks},
            "_nth": F.row_number().over(blocks),
        }
    )
    if peaks:
        carry = carry.withColumns({f"_c_{r.name}": F.max(F.col(f"_t_{r.name}") + F.col(f"_cs_{r.name}")).over(earlier) for r in peaks})
    kept = [f"_c_{r.name}" for r in running] + [f"_cs_{r.name}" for r in peaks]
    carry = carry.where(F.col("_nth") > 1).select(*keys, BLOCK, *kept)

    joined = scanned.join(carry, [*keys, BLOCK], "left")
    lifted = {r.name: F.col(f"_h_{r.name}") + F.coalesce(F.col(f"_cs_{r.name}"), F.lit(0)) for r in peaks}
    out = {r.name: _combine(r) for r in plain} | {n: F.greatest(c, F.col(f"_c_{n}")) for n, c in lifted.items()}
    return joined.select(*df.columns, *[out[r.name].alias(r.name) for r in running])


def positions(df: DataFrame, keys, order, name: str = "pos", blocks: int | None = None) -> DataFrame:
    """Zero-based position of each row within its key, for keys of any size."""
    stamped = blocked(df, keys, order, blocks, "positions")
    return scan(stamped, keys, order, Running(name, "count", F.lit(1), exclusive=True)).drop(BLOCK)


def grid_positions(df: DataFrame, key: str, part: str, order: str, name: str = "pos") -> DataFrame:
    """Positions for data on a time grid, where ``(key, part)`` is bounded by the grid.

    Per-part counts become offsets (one row per part), and only the bounded part
    is numbered, so nothing is written and no key is gathered.
    """
    sizes = df.groupBy(key, part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(key, part).orderBy(order)
    return (
        df.withColumn("_rn", F.row_number().over(within) - 1)
        .join(offsets, [key, part])
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_off", "_rn")
    )
