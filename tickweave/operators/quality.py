"""Data-quality checks: one row per failed check, one aggregate pass per stream.

Arrival order is followed without gathering a day in one task. Rows are cut into
blocks of ``BLOCK_ROWS`` arrival numbers; a ``(key, block)`` group holds at most
that many rows because the arrival number is unique within a stream. Steps
inside a block come from a window, steps across blocks from the first and last
row of each block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.schemas import missing_columns, nan_to_null
from tickweave.session import materialise

BLOCK_ROWS = 1 << 20

# Thresholds of the checks.
MAX_GAP_MS = 1_000
MAX_SPREAD_BPS = 50.0
WIDE_SHARE = 0.01
DRIFT_BPS = 1.0
DRIFT_SHARE = 0.05
HOUR_MS = 3_600_000

ERROR, WARNING = "ERROR", "WARNING"


@dataclass(frozen=True)
class RowCheck:
    """Counts rows where ``bad`` holds; ``first`` also reports the first time stamp."""

    name: str
    severity: str
    bad: Column
    first: bool = False


@dataclass(frozen=True)
class StepCheck:
    """Counts steps to the previous row where ``bad(step)`` holds."""

    name: str
    bad: object
    first: bool = False


def _sum_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def day_profile(df: DataFrame, rows, step_checks, keys=("symbol", "day"), ts="ts_ms", seq="seq", block_rows=BLOCK_ROWS):
    """Counts per ``keys``: ``n_rows`` and for each check ``n_<name>`` (and ``ts_<name>``)."""
    keys = list(keys)
    blk = F.floor(F.col(seq) / block_rows).cast("long").alias("_blk")
    df = df.select("*", blk)
    w = Window.partitionBy(*keys, "_blk").orderBy(seq)
    df = df.withColumn("_step", F.col(ts) - F.lag(ts).over(w))

    def first_at(cond: Column) -> Column:
        return F.min_by(ts, F.when(cond, F.col(seq)))

    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.min(seq).alias("_fseq"),
        F.min_by(ts, seq).alias("_fts"),
        F.max_by(ts, seq).alias("_lts"),
    ]
    for c in rows:
        aggs.append(_sum_if(c.bad).alias(f"n_{c.name}"))
        if c.first:
            aggs += [first_at(c.bad).alias(f"ts_{c.name}"), F.min(F.when(c.bad, F.col(seq))).alias(f"q_{c.name}")]
    for c in step_checks:
        bad = c.bad(F.col("_step"))
        aggs.append(_sum_if(bad).alias(f"n_{c.name}"))
        if c.first:
            aggs += [first_at(bad).alias(f"ts_{c.name}"), F.min(F.when(bad, F.col(seq))).alias(f"q_{c.name}")]
    blocks = df.groupBy(*keys, "_blk").agg(*aggs)

    across = Window.partitionBy(*keys).orderBy("_blk")
    blocks = blocks.withColumn("_edge", F.col("_fts") - F.lag("_lts").over(across))
    final = [F.sum("n_rows").alias("n_rows")]
    for c in rows:
        final.append(F.sum(f"n_{c.name}").alias(f"n_{c.name}"))
        if c.first:
            final.append(F.min_by(f"ts_{c.name}", f"q_{c.name}").alias(f"ts_{c.name}"))
    for c in step_checks:
        edge = F.coalesce(c.bad(F.col("_edge")), F.lit(False))
        final.append((F.sum(f"n_{c.name}") + _sum_if(edge)).alias(f"n_{c.name}"))
        if c.first:
            at = F.when(edge, F.col("_fts")).otherwise(F.col(f"ts_{c.name}"))
            by = F.when(edge, F.col("_fseq")).otherwise(F.col(f"q_{c.name}"))
            final.append(F.min_by(at, by).alias(f"ts_{c.name}"))
    return blocks.groupBy(*keys).agg(*final)


def issue(check: str, severity, n: Column, ts: Column | None = None, value: Column | None = None) -> Column:
    return F.struct(
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        F.lit(check).alias("check"),
        n.cast("long").alias("n"),
        (ts if ts is not None else F.lit(None)).cast("long").alias("ts_ms"),
        (value if value is not None else F.lit(None)).cast("double").alias("value"),
    )


def to_issues(profile: DataFrame, issues: list[Column], stream: str, keys=("symbol", "day")) -> DataFrame:
    """One row per check that failed at least once."""
    rows = profile.select(*keys, F.lit(stream).alias("stream"), F.explode(F.array(*issues)).alias("i"))
    return rows.select(*keys, "stream", "i.*").where("n > 0")


def column_issue(df: DataFrame, required, stream: str) -> list[str]:
    """Schema check; decided on the driver from the schema alone."""
    return sorted(missing_columns(df, required))


def schema_issues(df: DataFrame, required, stream: str, keys=("symbol", "day")) -> DataFrame:
    """An issue row per missing column and day, so that a schema fault reaches the gate like any other."""
    gone = column_issue(df, required, stream)
    issues = [issue(f"missing column {c}", ERROR, F.lit(1)) for c in gone]
    days = df.select(*keys).distinct()
    return to_issues(days if gone else days.limit(0), issues or [issue("missing column", ERROR, F.lit(1))], stream, keys)


def empty_days(expected: DataFrame, df: DataFrame, stream: str, severity: str, keys=("symbol", "day")) -> DataFrame:
    """Expected days without a single row."""
    have = df.select(*keys).distinct()
    gone = expected.select(*keys).join(have, list(keys), "left_anti")
    return to_issues(gone, [issue("empty", severity, F.lit(1))], stream, keys)


def _any(cols, test) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(test(F.col(c)), F.lit(False)) for c in cols])


BACKWARDS = StepCheck("monotonic", lambda s: s < 0)


def quote_issues(quotes: DataFrame, keys=("symbol", "day"), block_rows=BLOCK_ROWS) -> DataFrame:
    cols = ["bid_px", "ask_px", "bid_sz", "ask_sz"]
    rows = [
        RowCheck("nan", ERROR, _any(cols, lambda c: c.isNull() | F.isnan(c)) | _any(cols, lambda c: c.isNull())),
        RowCheck("crossed_book", ERROR, F.coalesce(F.col("bid_px") >= F.col("ask_px"), F.lit(False)), first=True),
        RowCheck("nonpositive", ERROR, _any(cols, lambda c: c <= 0)),
    ]
    # a NaN compares as larger than every number, so it must be missing before the checks
    p = day_profile(nan_to_null(quotes), rows, [BACKWARDS], keys, block_rows=block_rows)
    out = [issue("monotonic", ERROR, F.col("n_monotonic"))]
    out += [issue(c.name, ERROR, F.col(f"n_{c.name}"), F.col(f"ts_{c.name}") if c.first else None) for c in rows]
    return to_issues(p, out, "quotes", keys)


def trade_issues(trades: DataFrame, keys=("symbol", "day"), block_rows=BLOCK_ROWS) -> DataFrame:
    rows = [
        RowCheck("nonpositive_qty", ERROR, F.col("quantity") <= 0),
        RowCheck("nonpositive_price", ERROR, F.col("price") <= 0),
    ]
    p = day_profile(nan_to_null(trades), rows, [BACKWARDS], keys, block_rows=block_rows)
    out = [issue("monotonic", ERROR, F.col("n_monotonic"))]
    out += [issue(c.name, ERROR, F.col(f"n_{c.name}")) for c in rows]
    return to_issues(p, out, "trades", keys)


def depth_issues(depth: DataFrame, keys=("symbol", "day")) -> DataFrame:
    bad = (F.col("depth") < 0) | (F.col("notional") < 0)
    p = depth.groupBy(*keys).agg(_sum_if(F.coalesce(bad, F.lit(False))).alias("n_bad"))
    return to_issues(p, [issue("negative_depth", ERROR, F.col("n_bad"))], "depth", keys)


def snapshot_issues(
    snaps: DataFrame,
    grid_ms: int,
    max_gap_ms: int = MAX_GAP_MS,
    max_spread_bps: float = MAX_SPREAD_BPS,
    keys=("symbol", "day"),
    seq: str | None = None,
    block_rows=BLOCK_ROWS,
) -> DataFrame:
    """Issues of snapshots. ``seq`` orders rows of one key; without it, or a column ``seq``, the tick does."""
    if seq is None:
        seq = "seq" if "seq" in snaps.columns else "ts_ms"
    snaps = nan_to_null(snaps)
    cols = ["bid_px", "ask_px", "mid"]
    rows = [
        RowCheck("nan", ERROR, _any(cols, lambda c: c.isNull() | F.isnan(c)) | _any(cols, lambda c: c.isNull())),
        RowCheck("crossed_book", ERROR, F.coalesce(F.col("bid_px") >= F.col("ask_px"), F.lit(False))),
    ]
    if "log_spread_bps" in snaps.columns:
        rows.append(RowCheck("wide_spread", WARNING, F.coalesce(F.col("log_spread_bps") > max_spread_bps, F.lit(False))))
    steps = [
        BACKWARDS,
        StepCheck("uneven", lambda s: s != grid_ms),
        StepCheck("large", lambda s: (s != grid_ms) & (s > max_gap_ms), first=True),
    ]
    p = day_profile(snaps, rows, steps, keys, seq=seq, block_rows=block_rows)
    large = F.col("n_large") > 0
    out = [
        issue("monotonic", ERROR, F.col("n_monotonic")),
        issue(
            "snapshot_gap",
            F.when(large, ERROR).otherwise(WARNING),
            F.when(large, F.col("n_large")).otherwise(F.col("n_uneven")),
            F.when(large, F.col("ts_large")),
        ),
        issue("nan", ERROR, F.col("n_nan")),
        issue("crossed_book", ERROR, F.col("n_crossed_book")),
    ]
    if "log_spread_bps" in snaps.columns:
        share = F.col("n_wide_spread") / F.col("n_rows")
        many = F.col("n_wide_spread") > F.col("n_rows") * WIDE_SHARE
        out.append(issue("wide_spread", WARNING, F.when(many, F.col("n_wide_spread")).otherwise(0), value=share))
    return to_issues(p, out, "snapshots", keys)


def kline_matches(snaps: DataFrame, klines: DataFrame, by=("symbol", "day"), span_ms: int = HOUR_MS) -> DataFrame:
    """Each candle with the newest mid at or before its close, and the drift in basis points.

    Snapshots are reduced to one row per span before the shuffle, so the window
    that fills silent spans sees hours, not ticks.
    """
    by = list(by)
    label = F.col("ts_ms") - F.pmod("ts_ms", F.lit(span_ms)) + (span_ms - 1)
    last = snaps.groupBy(*by, label.alias("close_ms")).agg(F.max_by("mid", "ts_ms").alias("mid"))
    last = last.select(*by, "close_ms", F.struct("mid").alias("_src"))
    probe = klines.select(
        *by, (F.col("open_time") + span_ms - 1).alias("close_ms"), F.col("close"), F.lit(True).alias("_probe")
    ).where(F.col("close").isNotNull() & ~F.isnan("close"))
    both = probe.unionByName(last, allowMissingColumns=True)
    # at equal times the source row comes first: null probe flags sort ahead
    w = Window.partitionBy(*by).orderBy("close_ms", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_m", F.last("_src", ignorenulls=True).over(w)).where(F.col("_probe"))
    hit = seen.where(F.col("_m.mid") > 0)
    return hit.select(
        *by, "close_ms", "close", F.col("_m.mid").alias("mid"),
        (F.abs(F.col("_m.mid") - F.col("close")) / F.col("close") * 10_000).alias("drift_bps"),
    )


def kline_drift(snaps: DataFrame, klines: DataFrame, by=("symbol", "day"), limit_bps: float = DRIFT_BPS) -> DataFrame:
    """Drift verdict per group; a group of candles that met no snapshot gets a warning."""
    by = list(by)
    m = kline_matches(snaps, klines, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_checked"),
        _sum_if(F.col("drift_bps") > limit_bps).alias("n_bad"),
        F.max("drift_bps").alias("worst_bps"),
    )
    every = klines.select(*by).distinct().join(m, by, "left")
    checked, bad = F.coalesce("n_checked", F.lit(0)), F.coalesce("n_bad", F.lit(0))
    verdict = (
        F.when(checked == 0, WARNING)
        .when(bad / F.greatest(checked, F.lit(1)) > DRIFT_SHARE, ERROR)
        .when(bad > 0, WARNING)
        .otherwise("OK")
    )
    return every.select(
        *by, checked.alias("n_checked"), bad.alias("n_bad"), F.col("worst_bps"), verdict.alias("severity")
    )


def drift_issues(drift: DataFrame, keys=("symbol", "day")) -> DataFrame:
    none = F.col("n_checked") == 0
    checks = [
        issue("kline_xref_empty", WARNING, none.cast("int")),
        issue("mid_vs_kline_drift", F.col("severity"), F.col("n_bad"), value=F.col("worst_bps")),
    ]
    return to_issues(drift, checks, "snapshots", keys)


def all_issues(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def failing(issues: DataFrame, keys=("symbol", "day")) -> DataFrame:
    """Keys with at least one error."""
    return issues.where(F.col("severity") == ERROR).select(*keys).distinct()


def gate(df: DataFrame, issues: DataFrame, keys=("symbol", "day")) -> tuple[DataFrame, DataFrame]:
    """Rows of passing days, and the quarantined rest.

    The failing keys are written out, so both joins know their real size and the
    rows are not shuffled while that is small.
    """
    bad = materialise(failing(issues, keys), "failing")
    return df.join(bad, list(keys), "left_anti"), df.join(bad, list(keys), "left_semi")


def outcomes(expected: DataFrame, issues: DataFrame, keys=("symbol", "day")) -> DataFrame:
    """One row per expected key with its status and error count."""
    errs = issues.where(F.col("severity") == ERROR).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_errors"))
    out = expected.select(*keys).distinct().join(errs, list(keys), "left")
    n = F.coalesce("n_errors", F.lit(0))
    return out.select(*keys, F.when(n > 0, "failed").otherwise("ok").alias("status"), n.alias("n_errors"))


def require_all_ok(result: DataFrame) -> None:
    """Fail the job if any key failed; reads one aggregate row."""
    n = result.where(F.col("status") != "ok").count()
    if n:
        raise ValueError(f"{n} keys failed the quality gate")


def top_issues(issues: DataFrame, n: int = 20, keys=()) -> DataFrame:
    """The first ``n`` issues of each severity.

    Ordered limits per severity, so each partition keeps ``n`` rows at most.
    """
    order = [F.col("n").desc(), *[F.col(c) for c in ("check", "symbol", "day", "stream")]]
    tops = [issues.where(F.col("severity") == s).orderBy(*order).limit(n) for s in (ERROR, WARNING)]
    ranked = tops[0].unionByName(tops[1])
    w = Window.partitionBy("severity").orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(w))


def invalid_cells(df: DataFrame, cols, keys=()) -> DataFrame:
    """Count of missing, NaN or infinite cells per column, in one pass."""
    from tickweave.functions.quotes import is_invalid

    counts = df.groupBy(*keys).agg(*[_sum_if(is_invalid(F.col(c))).alias(c) for c in cols])
    return counts.unpivot(list(keys), list(cols), "column", "n_invalid")


def require_finite(df: DataFrame, cols) -> DataFrame:
    """Pass rows through; a non-finite value in any of ``cols`` stops the job."""
    from tickweave.functions.quotes import is_invalid

    checked = {
        c: F.when(is_invalid(F.col(c)), F.raise_error(F.lit(f"non-finite value in {c}")).cast("double")).otherwise(F.col(c))
        for c in cols
    }
    return df.withColumns(checked)


def require_min_rows(df: DataFrame, rows: int, keys=("symbol",)) -> DataFrame:
    """Keys with no more than ``rows`` rows; empty when the slab is long enough."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") <= rows)
