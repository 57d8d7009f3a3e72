"""Streaming twins of batch queries, run to the end of the given tables.

The event file is streamed as it is. A closing row far in the future follows in a
batch of its own and moves the watermark past every open window.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tickweave.functions.quotes import micro_price, mid
from tickweave.operators import stats
from tickweave.plans import checks as C
from tickweave.plans import market as M
from tickweave.plans import sqlviews as S
from tickweave.plans import views as V
from tickweave.plans.market import GRID_MS, day_text, r
from tickweave.plans.registry import SQL, query
from tickweave.session import materialise, new_path
from tickweave.streaming import run, ticks

CLOSING = "_close"


def event_stream(spark, d, closing: bool = True):
    schema = V.table(spark, d, "events").schema
    paths = [f"{d}/event[s].parquet"]
    if closing:
        tail = new_path(spark, "closing")
        row = (-1, datetime(2100, 1, 1), -1, CLOSING, 1.0, "{}")
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(tail)
        paths.append(f"{tail.removeprefix('file:')}/*.parquet")
    e = run.file_stream(spark, paths, schema)
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumns(
        {"ts_ms": F.unix_millis("ts"), "day": F.to_date("ts"), "symbol": F.col("event_type"), "seq": F.col("event_id")}
    )


def trade_stream(spark, d):
    qty, maker = (1 + F.col("user_id") % 10).cast("double"), F.col("event_id") % 2 == 0
    return event_stream(spark, d).select(
        "symbol", "day", "ts", "ts_ms", "seq", qty.alias("quantity"), F.when(maker, -qty).otherwise(qty).alias("signed_qty")
    )


def _real(df):
    return df.where(F.col("symbol") != CLOSING)


@query("stream_flow", SQL["trade_bucket_sums"])
def stream_flow(spark, d):
    flow = ticks.trade_flow(trade_stream(spark, d), GRID_MS)
    out = run.results(spark, run.run_to_end(flow, "flow"))
    return _real(out).select("symbol", day_text(), "tick", "signed_volume", "abs_volume", "trade_count")


_QUOTE_COLS = ["bid_px", "bid_sz", "ask_px", "ask_sz"]


@query(
    "stream_quotes_fill",
    f"""with {S.QUOTES}, {S.GRID}, {S.TOP}
select symbol, cast(day as varchar) as day, ts_ms, bid_px, bid_sz, round(ask_px,6) as ask_px, ask_sz from top""",
)
def stream_quotes_fill(spark, d):
    q = V._quotes(event_stream(spark, d), "ts")
    filled = ticks.fill_ticks(ticks.last_quotes(q, GRID_MS, _QUOTE_COLS), GRID_MS, _QUOTE_COLS)
    out = run.results(spark, run.run_to_end(filled, "fill"))
    return _real(out).select("symbol", day_text(), "ts_ms", "bid_px", "bid_sz", *r(["ask_px"]), "ask_sz")


@query(
    "stream_quotes_silent",
    f"""with {S.QUOTES}, b as (select symbol, day, min(ts_ms) as f from q group by 1,2),
g as (select symbol, day, unnest(generate_series((f+59999)//60000*60000, epoch_ms(day + interval 1 day), 60000)) as ts_ms from b), {S.TOP}
select symbol, cast(day as varchar) as day, ts_ms, bid_px, bid_sz, round(ask_px,6) as ask_px, ask_sz from top""",
)
def stream_quotes_silent(spark, d):
    """Keys that have no more quotes are filled by timers to the end of their day."""
    q = V._quotes(event_stream(spark, d), "ts")
    filled = ticks.fill_ticks(ticks.last_quotes(q, GRID_MS, _QUOTE_COLS), GRID_MS, _QUOTE_COLS, silent_ms=60 * GRID_MS)
    out = run.results(spark, run.run_to_end(filled, "silent"))
    return _real(out).select("symbol", day_text(), "ts_ms", "bid_px", "bid_sz", *r(["ask_px"]), "ask_sz")


def _priced(spark, d, name, value):
    """Newest quote per tick with one price computed from it."""
    q = V._quotes(event_stream(spark, d), "ts").withColumn(name, value)
    return ticks.last_quotes(q, GRID_MS, [name])


@query("stream_features", SQL["log_return_realized_vol"])
def stream_features(spark, d):
    m = mid(F.col("bid_px"), F.col("ask_px"))
    price = micro_price(F.col("bid_px"), F.col("bid_sz"), F.col("ask_px"), F.col("ask_sz"), m)
    live = ticks.price_features(_priced(spark, d, "micro_price", price), GRID_MS, M.VOL, M.RETURN_TICKS)
    out = run.results(spark, run.run_to_end(live, "features"))
    names = [f"realized_vol_{k}" for k in M.VOL]
    return _real(out).select("symbol", day_text(), "ts_ms", *r(["micro_price_log_ret"]), *r(names, 5))


@query("stream_alerts", SQL["risk_price_alerts"])
def stream_alerts(spark, d):
    live = ticks.price_alerts(
        _priced(spark, d, "mid", mid(F.col("bid_px"), F.col("ask_px"))), GRID_MS, jump=0.5, jump_ms=GRID_MS, crash=0.3,
        crash_ms=5 * GRID_MS, cooldown_ms=1_800_000,
    )
    out = run.results(spark, run.run_to_end(live, "alerts"))
    return _real(out).select("symbol", day_text(), "ts_ms", "price_jump", "crash", "blocked")


@query(
    "stream_rolling",
    f"""with {S.QUOTES}, {S.TRADES}, {S.GRID}, {S.FLOW}, x as (select *, {M._OFI_SQL}, {M._ABS_SQL} from flow)
select symbol, cast(day as varchar) as day, ts_ms, {", ".join(f"ofi_{k}" for k in M.FLOW)}, {M._IMB_SQL} from x""",
)
def stream_rolling(spark, d):
    flow = ticks.trade_flow(trade_stream(spark, d), GRID_MS)
    out = run.results(spark, run.run_to_end(ticks.rolling_flow(flow, GRID_MS, M.FLOW), "rolling"))
    names = [f"ofi_{k}" for k in M.FLOW]
    return _real(out).select("symbol", day_text(), "ts_ms", *names, *r([f"trade_flow_imb_{k}" for k in M.FLOW]))


@query(
    "stream_moments",
    f"with {S.EV} select symbol, count(*) as n, round(avg(value),6) as mean_value, round(stddev_pop(value),6) as std_value from ev group by 1",
)
def stream_moments(spark, d):
    m = ticks.moments(event_stream(spark, d, closing=False), ["value"])
    out = run.latest(run.results(spark, run.run_to_end(m, "moments", mode="update")), ["symbol"])
    return out.select("symbol", "n", *r(["mean_value", "std_value"]))


@query(
    "stream_zscore",
    f"""with {S.EV}, st as (select symbol, avg(value) as m, stddev_pop(value) as s from ev where day < date '2024-01-16' group by 1)
select ev.symbol, seq, round(greatest(least((value-m)/s,3),-3),6) as value from ev join st using (symbol)""",
)
def stream_zscore(spark, d):
    train = V.events(spark, d).where(F.col("day") < F.lit("2024-01-16").cast("date"))
    wide = materialise(stats.stats_wide(stats.norm_stats(train, ["value"]), ["value"]), "stats")
    live = event_stream(spark, d, closing=False).select("symbol", "seq", "value")
    out = run.results(spark, run.run_to_end(ticks.live_zscore(live, wide, ["value"], clip=3.0), "zscore"))
    return out.select("symbol", "seq", *r(["value"]))


@query(
    "stream_split",
    f"""with {C._DIRTY_Q}, x as (select *, coalesce(bid_px<ask_px and bid_px>0 and ask_px>0 and bid_sz>0 and ask_sz>0, false) as ok from dq)
select case when ok then 'passed' else 'rejected' end as sink, symbol, count(*) as n_rows, sum(seq)::bigint as seq_sum from x group by 1,2""",
)
def stream_split(spark, d):
    q = V.dirty(V._quotes(event_stream(spark, d, closing=False)))
    c = F.col
    good = (c("bid_px") < c("ask_px")) & (c("bid_px") > 0) & (c("ask_px") > 0) & (c("bid_sz") > 0) & (c("ask_sz") > 0)
    out = run.run_to_end(q, "split", batch=ticks.quality_split(good))
    both = [run.results(spark, out, s).withColumn("sink", F.lit(s)) for s in ("passed", "rejected")]
    return both[0].unionByName(both[1]).groupBy("sink", "symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("seq").alias("seq_sum")
    )


_BK = "over (partition by symbol order by tick rows between 2 preceding and current row)"


@query(
    "stream_breaches",
    f"""with {S.EV}, b as (select symbol, (ts_ms-1)//60000*60000+60000 as tick, arg_max(value, seq) as value from ev group by 1,2),
x as (select symbol, tick, count(*) {_BK} as n, min(value) {_BK} as lo, max(value) {_BK} as hi from b)
select symbol, tick, n=3 and (lo>60 or hi<5) as breach from x""",
)
def stream_breaches(spark, d):
    e = event_stream(spark, d).select("symbol", "ts", "ts_ms", "seq", "value")
    t = ticks.last_quotes(e, GRID_MS, ["value"], by=("symbol",))
    out = run.results(spark, run.run_to_end(ticks.breach_runs(t, hi=60.0, lo=5.0, k=3), "breaches"))
    return _real(out).select("symbol", "tick", "breach")
