"""Leakage-free splits over ordered slabs of any size."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.operators.scan import Running, blocked, positions, scan
from tickweave.session import materialise

ROWS_PER_DAY = 864_000  # fixed value: ticks of a day on the 100 ms grid


def hash_mod(modulus: Column, *parts: Column) -> Column:
    """Repeatable draw in ``[0, modulus)`` from the text of ``parts``."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus.cast("long"))


def slab_sizes(df: DataFrame, keys) -> DataFrame:
    """Rows per key, written out so that the planner knows its real size.

    The planner then broadcasts it below its own size limit and shuffles beyond.
    """
    return materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total")), "sizes")


def part_offsets(df: DataFrame, keys, part: str) -> DataFrame:
    """Rows ``_n`` of every part of a slab, the rows ``_off`` before it, and ``n_total``; one row a part, written."""
    keys = list(keys)
    sizes = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
    slab = Window.partitionBy(*keys)
    before = slab.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return materialise(
        sizes.withColumns({"_off": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n_total": F.sum("_n").over(slab)}), "offsets"
    )


def _numbered(df: DataFrame, offsets: DataFrame, keys, part: str, order) -> DataFrame:
    """``pos`` and ``n_total`` of the rows of the parts in ``offsets``; only these parts are sorted, each by itself."""
    keys = list(keys)
    held = df.join(offsets.select(*keys, part, "_off", "n_total"), [*keys, part])
    within = Window.partitionBy(*keys, part).orderBy(*order)
    return held.withColumn("pos", F.col("_off") + F.row_number().over(within) - 1).drop("_off")


def with_positions(df: DataFrame, keys, order, blocks=None, part: str | None = None) -> DataFrame:
    """``pos`` (zero based) and ``n_total`` of the slab each row belongs to.

    With ``part``, a column whose order is that of the rows (a day), positions are offsets of
    parts plus the place inside one: no range sort over the slab and nothing written but one
    row a part. Without it, rows are placed in blocks, for slabs of any shape.
    """
    keys = list(keys)
    if part is not None:
        return _numbered(df, part_offsets(df, keys, part), keys, part, order)
    placed = positions(df, keys, order, blocks=blocks)
    return placed.join(slab_sizes(df, keys), keys)


def chrono_split(
    df: DataFrame, ratio: float = 0.8, keys=("symbol",), order=("ts_ms", "seq"), blocks=None, part: str | None = None
) -> DataFrame:
    """The first ``int(n * ratio)`` rows of each slab are ``train``, the rest ``eval``."""
    if not 0.5 <= ratio < 1.0:
        raise ValueError(f"ratio must be in [0.5, 1.0), got {ratio}")
    cut = F.floor(F.col("n_total") * F.lit(float(ratio)))
    placed = with_positions(df, keys, order, blocks, part)
    return placed.withColumn("split", F.when(F.col("pos") < cut, "train").otherwise("eval"))


def holdout_split(
    df: DataFrame, days: float, rows_per_day: int = ROWS_PER_DAY, keys=("symbol",), order=("ts_ms", "seq"), blocks=None,
    part: str | None = None,
) -> DataFrame:
    """The last ``round(days * rows_per_day)`` rows are ``holdout``, earlier ones ``selection``."""
    n_hold = int(round(days * rows_per_day))
    placed = with_positions(df, keys, order, blocks, part)
    short = F.raise_error(F.concat(F.lit(f"holdout of {n_hold} rows is not below slab size "), F.col("n_total").cast("string")))
    total = F.when(F.col("n_total") > n_hold, F.col("n_total")).otherwise(short.cast("long"))
    return placed.withColumn("split", F.when(F.col("pos") >= total - n_hold, "holdout").otherwise("selection"))


def tail_rows(
    df: DataFrame, n: int, keys=("symbol",), order=("ts_ms", "seq"), blocks=None, part: str | None = None
) -> DataFrame:
    """The last ``n`` rows of each slab, by position. With ``part`` only the parts that hold them are read and sorted."""
    first = F.col("n_total") - n
    if part is None:
        return with_positions(df, keys, order, blocks).where(F.col("pos") >= first)
    touched = part_offsets(df, keys, part).where(F.col("_off") + F.col("_n") > first)
    return _numbered(df, touched, keys, part, order).where(F.col("pos") >= first)


def check_window(train_start: str, train_end: str, eval_start: str, eval_end: str) -> None:
    if eval_start <= train_end:
        raise ValueError(f"eval_start {eval_start} must be after train_end {train_end}")
    if train_start > train_end or eval_start > eval_end:
        raise ValueError("a window ends before it starts")


def walk_forward_split(df: DataFrame, train_start, train_end, eval_start, eval_end, day="day") -> DataFrame:
    """One train and one eval window, both inclusive; a filter that prunes day partitions."""
    check_window(train_start, train_end, eval_start, eval_end)
    d = F.col(day)

    def inside(a, b):
        return d.between(F.lit(a).cast("date"), F.lit(b).cast("date"))

    train, held = inside(train_start, train_end), inside(eval_start, eval_end)
    return df.where(train | held).withColumn("split", F.when(train, "train").otherwise("eval"))


def make_folds(start: str, end: str, train_days: int, eval_days: int, step_days: int) -> list[tuple[str, str, str, str]]:
    """Rolling windows inside ``[start, end]``; eval starts the day after train ends."""
    out, first, last = [], date.fromisoformat(start), date.fromisoformat(end)
    while first + timedelta(days=train_days + eval_days - 1) <= last:
        t_end = first + timedelta(days=train_days - 1)
        e_start = t_end + timedelta(days=1)
        e_end = e_start + timedelta(days=eval_days - 1)
        out.append(tuple(d.isoformat() for d in (first, t_end, e_start, e_end)))
        first += timedelta(days=step_days)
    return out


def walk_forward_folds(df: DataFrame, folds, day="day") -> DataFrame:
    """Rows of every fold with ``fold`` and ``split``.

    The folds are spelled out per day, so membership is an equi-join on the day
    against a calendar made from the argument list.
    """
    for f in folds:
        check_window(*f)
    spark = df.sparkSession
    rows = [(i, s, a, b) for i, f in enumerate(folds) for s, a, b in (("train", f[0], f[1]), ("eval", f[2], f[3]))]
    cal = spark.createDataFrame(rows, "fold int, split string, a string, b string").select(
        "fold", "split", F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"))).alias(day)
    )
    bounds = [f[0] for f in folds] + [f[3] for f in folds]
    pruned = df.where(F.col(day).between(F.lit(min(bounds)).cast("date"), F.lit(max(bounds)).cast("date")))
    return pruned.join(cal, day)


def uncovered(df: DataFrame, folds, day="day") -> DataFrame:
    """Rows whose day lies in no window of any fold, such as those after the last fold."""
    held = F.lit(False)
    for a, b in {w for f in folds for w in ((f[0], f[1]), (f[2], f[3]))}:
        held = held | F.col(day).between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return df.where(~F.coalesce(held, F.lit(False)))


def require_every_fold(counts: DataFrame, n_folds: int) -> None:
    """An empty window is an error. Reads one row per fold and split."""
    n = counts.select("fold", "split").distinct().count()
    if n != 2 * n_folds:
        raise ValueError(f"{2 * n_folds - n} windows hold no rows")


def sample_windows(
    df: DataFrame, n_samples: int, length: int, seed: int, keys=("symbol",), order=("ts_ms", "seq"), blocks=None,
    part: str | None = None,
) -> DataFrame:
    """``n_samples`` windows of ``length`` consecutive rows: slab uniform, start uniform.

    Each wanted position becomes one row, so the slab is met by an equi-join on
    ``(key, pos)`` and no range condition is needed. With ``part`` only the parts that the
    windows touch are read and sorted.
    """
    keys = list(keys)
    spark = df.sparkSession
    if part is None:
        placed, sizes = positions(df, keys, order, blocks=blocks), slab_sizes(df, keys)
    else:
        offsets = part_offsets(df, keys, part)
        sizes = materialise(offsets.select(*keys, "n_total").distinct(), "sizes")
    sizes = sizes.where(F.col("n_total") > length + 1)
    ranked = positions(sizes, [], keys, "_slab")
    n_slabs = F.lit(sizes.count())
    draws = spark.range(n_samples).withColumnRenamed("id", "sample_id")
    draws = draws.withColumn("_slab", hash_mod(n_slabs, F.lit(seed), F.lit("slab"), F.col("sample_id")))
    starts = draws.join(ranked, "_slab").withColumn(
        "start", hash_mod(F.col("n_total") - length - 1, F.lit(seed), F.lit("start"), F.col("sample_id"))
    )
    if part is not None:
        # one row a sample meets one row a part
        near = offsets.join(starts.select(*keys, "start"), keys)
        near = near.where((F.col("_off") < F.col("start") + length) & (F.col("_off") + F.col("_n") > F.col("start")))
        touched = near.select(*offsets.columns).distinct()
        placed = _numbered(df, touched, keys, part, order).drop("n_total")
    wanted = starts.select(
        *keys, "sample_id", "start", F.explode(F.sequence(F.col("start"), F.col("start") + length - 1)).alias("pos")
    )
    return placed.join(wanted, [*keys, "pos"])


def split_bounds(df: DataFrame, keys=("symbol",), ts="ts_ms") -> DataFrame:
    """Rows and time range of each split, the body of the manifest."""
    return df.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("start_ms"), F.max(ts).alias("end_ms")
    )


def order_violations(bounds: DataFrame, first: str = "train", second: str = "eval", keys=("symbol",)) -> DataFrame:
    """Slabs whose second split starts at or before the end of the first."""
    wide = bounds.groupBy(*keys).agg(
        F.max(F.when(F.col("split") == first, F.col("end_ms"))).alias("first_end_ms"),
        F.min(F.when(F.col("split") == second, F.col("start_ms"))).alias("second_start_ms"),
    )
    return wide.where(F.col("second_start_ms") <= F.col("first_end_ms"))


def non_increasing(df: DataFrame, keys=("symbol",), order=("day", "seq"), ts: str = "ts_ms", blocks=None) -> DataFrame:
    """Keys whose time stamp does not strictly increase in the given order, and how often."""
    keys, order = list(keys), list(order)
    stamped = blocked(df.select(*dict.fromkeys([*keys, *order, ts])), keys, order, blocks, "order")
    seen = scan(stamped, keys, order, Running("_before", "last", F.struct(F.col(ts).alias("t")), exclusive=True))
    return seen.where(F.col(ts) <= F.col("_before.t")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bad"))


SEQ_SPAN = 10**19  # above every 64-bit sequence number


def concat_dedupe(frames: list[DataFrame], keys=("symbol", "ts_ms"), seq="seq", day: str | None = "day") -> DataFrame:
    """Union by name, then the first row by ``(day, seq)`` per key; of equal ones that of the earliest frame.

    An aggregate with a map-side combine, so copies of one key never meet in full. The
    order is one decimal: as a number it stays in a hash aggregate, as a struct it would sort.
    """
    every = frames[0].withColumn("_frame", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        every = every.unionByName(f.withColumn("_frame", F.lit(i)))
    wide = "decimal(38,0)"
    turn = (F.col(seq).cast(wide) + SEQ_SPAN // 2) * len(frames) + F.col("_frame")
    if day in every.columns:
        turn = F.unix_date(day).cast("decimal(8,0)") * F.lit(SEQ_SPAN * len(frames)).cast(wide) + turn
    turn = turn.cast(wide)
    every = every.withColumn("_turn", turn)
    rest = [c for c in every.columns if c not in (*keys, "_frame", "_turn")]
    return every.groupBy(*keys).agg(*[F.min_by(c, "_turn").alias(c) for c in rest])
