"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.operators import quality
from tickweave.plans import sqlviews as S
from tickweave.plans import views as V
from tickweave.plans.market import GRID_MS, day_text, snaps
from tickweave.plans.registry import query

_DIRTY_Q = f"""{S.QUOTES}, dq as (
  select symbol, day, ts_ms, seq, case when seq%83<>0 then bid_px end as bid_px,
         case when seq%89=0 then 0.0::double else bid_sz end as bid_sz,
         case when seq%97=0 then bid_px-cast(0.01 as double) else ask_px end as ask_px, ask_sz from q)"""

_QUOTE_ISSUES = f"""{_DIRTY_Q}, st as (
  select *, ts_ms - lag(ts_ms) over (partition by symbol, day order by seq) as step from dq),
p as (select symbol, day,
   count(*) filter (step<0) as n_mono,
   count(*) filter (bid_px is null or ask_px is null or bid_sz is null or ask_sz is null) as n_nan,
   count(*) filter (bid_px>=ask_px) as n_crossed, arg_min(ts_ms, seq) filter (bid_px>=ask_px) as ts_crossed,
   count(*) filter (bid_px<=0 or ask_px<=0 or bid_sz<=0 or ask_sz<=0) as n_nonpos
 from st group by 1,2),
qi as (
 select symbol, day, 'quotes' as stream, 'ERROR' as severity, 'monotonic' as "check", n_mono as n, cast(null as bigint) as ts_ms from p
 union all select symbol, day, 'quotes', 'ERROR', 'nan', n_nan, null from p
 union all select symbol, day, 'quotes', 'ERROR', 'crossed_book', n_crossed, ts_crossed from p
 union all select symbol, day, 'quotes', 'ERROR', 'nonpositive', n_nonpos, null from p)"""

_TRADE_ISSUES = f"""{S.TRADES}, dt as (
  select * replace (case when seq%101=0 then 0.0::double else quantity end as quantity) from t),
tp as (select symbol, day, count(*) filter (quantity<=0) as n_qty, count(*) filter (price<=0) as n_px from dt group by 1,2),
ti as (
 select symbol, day, 'trades' as stream, 'ERROR' as severity, 'nonpositive_qty' as "check", n_qty as n, cast(null as bigint) as ts_ms from tp
 union all select symbol, day, 'trades', 'ERROR', 'nonpositive_price', n_px, null from tp)"""

_COLS = 'symbol, cast(day as varchar) as day, stream, severity, "check", n, coalesce(ts_ms,-1) as ts_ms'


def _issues(df):
    return df.select(
        "symbol", day_text(), "stream", "severity", "check", "n", F.coalesce("ts_ms", F.lit(-1)).alias("ts_ms")
    )


@query("quote_issues", f"with {_QUOTE_ISSUES} select {_COLS} from qi where n>0")
def quote_issues(spark, d):
    return _issues(quality.quote_issues(V.quotes_dirty(spark, d)))


@query("trade_issues", f"with {S.EV}, {_TRADE_ISSUES} select {_COLS} from ti where n>0")
def trade_issues(spark, d):
    return _issues(quality.trade_issues(V.trades_dirty(spark, d)))


_DEPTH_DIRTY = "case when seq%50=7 then -depth else depth end"


@query(
    "depth_issues",
    f"""with {S.EV}, {S.DEPTH}, x as (select symbol, day, {_DEPTH_DIRTY} as depth, {_DEPTH_DIRTY}*value as notional from d)
select symbol, cast(day as varchar) as day, 'depth' as stream, 'ERROR' as severity, 'negative_depth' as "check",
  count(*) as n, -1 as ts_ms from x where depth<0 or notional<0 group by 1,2""",
)
def depth_issues(spark, d):
    flip = F.when(F.col("seq") % 50 == 7, -1.0).otherwise(1.0)
    dirty = V.depth(spark, d).withColumns({"depth": F.col("depth") * flip, "notional": F.col("notional") * flip})
    return _issues(quality.depth_issues(dirty))


# snapshots with defects: a dropped stretch becomes a gap, every 71st book is crossed, some mids go missing
def dirty_snaps(spark, d):
    s = snaps(spark, d, quotes_only=True)
    tick = (F.col("ts_ms") / GRID_MS).cast("long")
    return s.select(
        "symbol",
        "day",
        tick.alias("seq"),
        # a tick whose number ends in 000 arrives late, leaving a gap on both sides
        F.when(tick % 1000 == 0, F.col("ts_ms") + 30_000).otherwise(F.col("ts_ms")).alias("ts_ms"),
        "bid_px",
        F.when(tick % 71 == 0, F.col("bid_px") - 1).otherwise(F.col("ask_px")).alias("ask_px"),
        F.when(tick % 333 != 0, F.col("mid")).alias("mid"),
        "log_spread_bps",
    )


@query(
    "snapshot_issues",
    f"""with {S.QUOTES}, {S.GRID}, {S.TOP}, s as (
  select symbol, day, ts_ms//60000 as seq, case when (ts_ms//60000)%1000=0 then ts_ms+30000 else ts_ms end as ts_ms,
    bid_px, case when (ts_ms//60000)%71=0 then bid_px-1 else ask_px end as ask_px,
    case when (ts_ms//60000)%333<>0 then mid end as mid, log_spread_bps from top),
st as (select *, ts_ms-lag(ts_ms) over (partition by symbol, day order by seq) as step from s),
p as (select symbol, day, count(*) as n_rows, count(*) filter (step<0) as n_mono,
  count(*) filter (step<>60000) as n_uneven, count(*) filter (step<>60000 and step>75000) as n_large,
  arg_min(ts_ms, seq) filter (step<>60000 and step>75000) as ts_large,
  count(*) filter (bid_px is null or ask_px is null or mid is null) as n_nan,
  count(*) filter (bid_px>=ask_px) as n_crossed, count(*) filter (log_spread_bps>50) as n_wide from st group by 1,2),
i as (
 select symbol, day, 'ERROR' as severity, 'monotonic' as "check", n_mono as n, cast(null as bigint) as ts_ms from p
 union all select symbol, day, case when n_large>0 then 'ERROR' else 'WARNING' end, 'snapshot_gap',
   case when n_large>0 then n_large else n_uneven end, ts_large from p
 union all select symbol, day, 'ERROR', 'nan', n_nan, null from p
 union all select symbol, day, 'ERROR', 'crossed_book', n_crossed, null from p
 union all select symbol, day, 'WARNING', 'wide_spread', case when n_wide>n_rows*0.01 then n_wide else 0 end, null from p)
select symbol, cast(day as varchar) as day, 'snapshots' as stream, severity, "check", n, coalesce(ts_ms,-1) as ts_ms
from i where n>0""",
)
def snapshot_issues(spark, d):
    return _issues(quality.snapshot_issues(dirty_snaps(spark, d), GRID_MS, max_gap_ms=75_000))


_DRIFT = f"""{S.QUOTES}, {S.KLINES}, {S.GRID}, {S.TOP}, m as (
  select k.symbol, k.day, k.open_time, abs(top.mid-k.close)/k.close*10000 as drift_bps
  from k asof join top on k.symbol=top.symbol and k.day=top.day and k.open_time+3599999>=top.ts_ms
  where top.mid>0),
dr as (select k.symbol, k.day, count(m.drift_bps) as n_checked, count(*) filter (m.drift_bps>1) as n_bad,
  max(m.drift_bps) as worst from k left join m on k.symbol=m.symbol and k.day=m.day and k.open_time=m.open_time group by 1,2)"""


@query(
    "kline_drift",
    f"""with {_DRIFT} select symbol, cast(day as varchar) as day, n_checked, n_bad, round(worst,4) as worst_bps,
 case when n_checked=0 then 'WARNING' when n_bad/greatest(n_checked,1)>0.05 then 'ERROR'
      when n_bad>0 then 'WARNING' else 'OK' end as severity from dr""",
)
def kline_drift(spark, d):
    out = quality.kline_drift(snaps(spark, d, quotes_only=True), V.klines(spark, d))
    return out.select("symbol", day_text(), "n_checked", "n_bad", F.round("worst_bps", 4).alias("worst_bps"), "severity")


@query(
    "quality_gate_days",
    f"""with {_QUOTE_ISSUES}, bad as (select distinct symbol, day from qi where n>0)
select symbol, cast(day as varchar) as day, count(*) as n_rows,
  sum(case when (symbol, day) in (select (symbol, day) from bad) then 1 else 0 end)::bigint as n_quarantined
from dq group by 1,2""",
)
def quality_gate_days(spark, d):
    q = V.quotes_dirty(spark, d)
    kept, held = quality.gate(q, quality.quote_issues(q))
    both = kept.select("symbol", "day", F.lit(0).alias("q")).unionByName(held.select("symbol", "day", F.lit(1).alias("q")))
    return both.groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("q").alias("n_quarantined")
    ).select("symbol", day_text(), "n_rows", "n_quarantined")


@query(
    "issues_topn",
    f"""with {_QUOTE_ISSUES}, {_TRADE_ISSUES}, a as (
  select * from qi where n>0 union all select * from ti where n>0),
x as (select *, row_number() over (partition by severity order by n desc, "check", symbol, day, stream) as rank from a)
select symbol, cast(day as varchar) as day, stream, severity, "check", n, rank from x where rank<=20""",
)
def issues_topn(spark, d):
    every = quality.all_issues(
        quality.quote_issues(V.quotes_dirty(spark, d)),
        quality.trade_issues(V.trades_dirty(spark, d)),
        quality.depth_issues(V.depth(spark, d)),
    )
    return quality.top_issues(every).select("symbol", day_text(), "stream", "severity", "check", "n", F.col("rank").cast("long").alias("rank"))


@query(
    "day_outcomes",
    f"""with {_QUOTE_ISSUES}, e as (select symbol, day, count(*) as n_errors from qi where n>0 group by 1,2)
select status, count(*) as n_days, sum(n_errors)::bigint as n_errors from (
  select case when e.n_errors is null then 'ok' else 'failed' end as status, coalesce(e.n_errors,0) as n_errors
  from (select distinct symbol, day from dq) x left join e using (symbol, day)) group by 1""",
)
def day_outcomes(spark, d):
    q = V.quotes_dirty(spark, d)
    out = quality.outcomes(q.select("symbol", "day"), quality.quote_issues(q))
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n_days"), F.sum("n_errors").alias("n_errors"))


_CELLS = ("bid_px", "bid_sz", "ask_px", "ask_sz", "ratio")


@query(
    "invalid_cells",
    f"""with {_DIRTY_Q}, x as (select *, case when bid_sz=0 then null else ask_sz/bid_sz end as ratio from dq)
select symbol, c as "column", n as n_invalid from (
  select symbol, {", ".join(f"count(*) filter ({c} is null or isnan({c}) or isinf({c})) as {c}" for c in _CELLS)} from x group by 1)
unpivot (n for c in ({", ".join(_CELLS)}))""",
)
def invalid_cells(spark, d):
    q = V.quotes_dirty(spark, d)
    # zero sizes make an infinite ratio, missing prices stay null
    inf = F.lit(float("inf"))
    q = q.withColumn("ratio", F.when(F.col("bid_sz") == 0, inf).otherwise(F.col("ask_sz") / F.col("bid_sz")))
    return quality.invalid_cells(q, _CELLS, ["symbol"])
