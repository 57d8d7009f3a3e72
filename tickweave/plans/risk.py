"""Risk alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.operators import alerts
from tickweave.plans import logs as L
from tickweave.plans import sqlviews as S
from tickweave.plans import views as V
from tickweave.plans.market import GRID_MS, day_text, snaps
from tickweave.plans.registry import query
from tickweave.session import materialise

_W = "over (partition by symbol order by ts_ms)"


@query(
    "risk_price_alerts",
    f"""with {S.QUOTES}, {S.GRID}, {S.TOP},
pa as (select *, abs(mid/nullif(lag(mid,1) {_W},0)-1) > 0.5 as j, mid/nullif(lag(mid,5) {_W},0)-1 <= -0.3 as c from top),
pb as (select *, max(case when c then ts_ms end) over (partition by symbol order by ts_ms rows unbounded preceding) as last from pa)
select symbol, cast(day as varchar) as day, ts_ms, coalesce(j,false) as price_jump, coalesce(c,false) as crash, coalesce(ts_ms-last<=1800000,false) as blocked from pb""",
)
def risk_price_alerts(spark, d):
    # several steps read the snapshots, so they are stored first
    s = materialise(snaps(spark, d, quotes_only=True), "snapshots")
    out = alerts.price_alerts(s, GRID_MS, jump=0.5, jump_ms=GRID_MS, crash=0.3, crash_ms=5 * GRID_MS, cooldown_ms=1_800_000)
    return out.select("symbol", day_text(), "ts_ms", "price_jump", "crash", "blocked")


@query(
    "risk_account_alerts",
    f"""with {L._NAV}, a as (select *, max(case when streak>=3 then ts_ms end) {L._W} as loss_at, count(*) filter (drawdown>=0.01) {L._W} as fell from n3)
select user_id, seq, coalesce(ts_ms-loss_at<=86400000,false) as loss_pause, fell>0 as drawdown_stop from a""",
)
def risk_account_alerts(spark, d):
    out = alerts.account_alerts(L.nav_rows(spark, d), L.KEYS, L.ORDER, losses=3, cooldown_ms=86_400_000, trailing=0.01)
    return out.select("user_id", "seq", "loss_pause", "drawdown_stop")


@query(
    "risk_outflow",
    f"""with {S.EV}, h as (select user_id, ts_ms//3600000*3600000 as bucket_ms, sum(case when seq%3=0 then value else 0 end) as outflow,
   arg_min(200.0+seq%50, ts_ms) as opening from ev group by 1,2),
w as (select *, sum(outflow) over r as outflow_day, first_value(opening) over r as opening_day from h
  window r as (partition by user_id order by bucket_ms range between 82800000 preceding and current row))
select user_id, bucket_ms, round(outflow_day,6) as outflow_day, opening_day, outflow_day/opening_day>0.2 as redemption_pause from w""",
)
def risk_outflow(spark, d):
    e = V.events(spark, d).withColumns(
        {"amount": F.when(F.col("seq") % 3 == 0, -F.col("value")).otherwise(F.col("value")), "nav": 200.0 + F.col("seq") % 50}
    )
    out = alerts.outflow_alerts(e, by=["user_id"], value="nav")
    return out.select("user_id", "bucket_ms", F.round("outflow_day", 6).alias("outflow_day"), "opening_day", "redemption_pause")


@query(
    "risk_exposure",
    f"""with {S.QUOTES}, {S.TRADES}, {S.ORDERS}, {S.FUNDING}, x as (
  select o.order_id, o.side, o.notional, f.funding_rate*10 as rate from o asof left join f on o.symbol=f.symbol and o.ts_ms>=f.ts_ms)
select order_id, coalesce(rate*side>0.0005,false) as funding_gate, notional/10000>0.3 as over_notional, notional/10000>6 as over_leverage from x""",
)
def risk_exposure(spark, d):
    from tickweave.operators.asof import asof_join

    o = V.orders_x(spark, d).select("order_id", "symbol", "ts_ms", "side", "notional")
    f = V.funding(spark, d).select("symbol", "ts_ms", "funding_rate")
    x = asof_join(o, f, ["symbol"], ["funding_rate"], left_id="order_id")
    x = x.withColumns({"rate": F.col("funding_rate") * 10, "nav": F.lit(10_000.0)})
    out = alerts.exposure_alerts(x, "rate", "side", "notional", "nav")
    return out.select("order_id", "funding_gate", "over_notional", "over_leverage")


@query(
    "asof_points",
    f"""with {S.QUOTES}, {S.TRADES}, p as (select seq, symbol, ts_ms-1000 as ts_ms from t)
select p.seq, p.symbol, q.bid_px, round(q.ask_px,6) as ask_px from p asof left join q on p.symbol=q.symbol and p.ts_ms>=q.ts_ms""",
)
def asof_points(spark, d):
    """Quotes one second before each trade, across days."""
    from tickweave.operators.asof import asof_join

    p = V.trades(spark, d).select("seq", "symbol", (F.col("ts_ms") - 1000).alias("ts_ms"))
    q = V.quotes(spark, d).select("symbol", "ts_ms", "seq", "bid_px", "ask_px")
    out = asof_join(p, q, ["symbol"], ["bid_px", "ask_px"], right_seq="seq")
    return out.select("seq", "symbol", "bid_px", F.round("ask_px", 6).alias("ask_px"))
