"""The fixture views and shared steps as SQL, for the reference side only."""

EV = """ev as (
  select event_id, user_id, event_type, value, props, epoch_us(ts)//1000 as ts_ms,
         cast(ts as date) as day, event_type as symbol, event_id as seq from events)"""

QUOTES = EV + """, q as (
  select symbol, day, ts_ms, seq, value as bid_px,
         value + cast(0.01 as double)*(1+event_id%5) as ask_px,
         cast(1+user_id%7 as double) as bid_sz, cast(1+event_id%4 as double) as ask_sz from ev)"""

TRADES = """t as (
  select symbol, day, ts_ms, seq, value as price, cast(1+user_id%10 as double) as quantity,
         event_id%2=0 as is_buyer_maker,
         case when event_id%2=0 then -cast(1+user_id%10 as double) else cast(1+user_id%10 as double) end as signed_qty
  from ev)"""

DEPTH = """d as (
  select symbol, day, ts_ms, seq, lvl as level,
         case when lvl<>10 or event_id%20<>0 then cast(5+abs(lvl)*(1+user_id%3) as double) end as depth, value
  from ev, (select unnest([-10,-5,-2,-1,1,2,5,10]) as lvl))"""

FUNDING = """f as (
  select symbol, ts_ms//28800000*28800000 as ts_ms, (count(*)%21-10)/100000.0::double as funding_rate
  from ev group by 1,2)"""

KLINES = """k as (
  select symbol, open_time, cast(make_timestamp(open_time*1000) as date) as day,
         case when (open_time//3600000)%6=0 then m*cast(1.0005 as double) else m end as close
  from (select symbol, ts_ms//3600000*3600000 as open_time, (arg_max(bid_px, seq)+arg_max(ask_px, seq))/2 as m
        from q group by 1,2))"""

ORDERS = """o as (
  select seq as order_id, symbol, day, ts_ms, case when is_buyer_maker then -1 else 1 end as side,
         quantity*1000 as notional from t)"""

# one-minute grid per symbol and day, quotes as of each tick
GRID = """b as (select symbol, day, min(ts_ms) as f, max(ts_ms) as l from q group by 1,2),
g as (select symbol, day, unnest(generate_series((f+59999)//60000*60000, l//60000*60000, 60000)) as ts_ms from b)"""

TOP = """top as (
  select g.symbol, g.day, g.ts_ms, q.bid_px, q.bid_sz, q.ask_px, q.ask_sz, (q.bid_px+q.ask_px)/2 as mid,
         case when q.bid_sz+q.ask_sz>0 then (q.bid_px*q.ask_sz+q.ask_px*q.bid_sz)/(q.bid_sz+q.ask_sz)
              else (q.bid_px+q.ask_px)/2 end as micro_price,
         case when q.bid_px+q.ask_px>0 then ln(1+greatest(q.ask_px-q.bid_px,0)/((q.bid_px+q.ask_px)/2))*10000 else 0 end as log_spread_bps,
         coalesce((q.bid_sz-q.ask_sz)/nullif(q.bid_sz+q.ask_sz,0),0) as top1_size_imbalance
  from g asof join q on g.symbol=q.symbol and g.day=q.day and g.ts_ms>=q.ts_ms)"""

FLOW = """fl as (
  select symbol, day, ts_ms//60000*60000+60000 as ts_ms, sum(signed_qty) as signed_volume,
         sum(quantity) as abs_volume, count(*) as trade_count from t group by 1,2,3),
flow as (
  select g.symbol, g.day, g.ts_ms, coalesce(signed_volume,0) as signed_volume,
         coalesce(abs_volume,0) as abs_volume, coalesce(trade_count,0) as trade_count
  from g left join fl on g.symbol=fl.symbol and g.day=fl.day and g.ts_ms=fl.ts_ms)"""

WIDE = """w0 as (
  select symbol, day, ts_ms,
    max(case when level=-1 then depth end) as bid_depth_pct_neg_0_1,
    max(case when level=-2 then depth end) as bid_depth_pct_neg_0_2,
    max(case when level=-5 then depth end) as bid_depth_pct_neg_0_5,
    max(case when level=-10 then depth end) as bid_depth_pct_neg_1_0,
    max(case when level=1 then depth end) as ask_depth_pct_pos_0_1,
    max(case when level=2 then depth end) as ask_depth_pct_pos_0_2,
    max(case when level=5 then depth end) as ask_depth_pct_pos_0_5,
    max(case when level=10 then depth end) as ask_depth_pct_pos_1_0
  from d group by 1,2,3),
wide as (
  select g.symbol, g.day, g.ts_ms, w0.* exclude (symbol, day, ts_ms)
  from g asof left join w0 on g.symbol=w0.symbol and g.day=w0.day and g.ts_ms>=w0.ts_ms)"""

RATE = """rate as (
  select g.symbol, g.day, g.ts_ms, f.funding_rate
  from g asof left join f on g.symbol=f.symbol and g.ts_ms>=f.ts_ms)"""

SNAPS = (
    "with " + ", ".join([QUOTES, TRADES, DEPTH, FUNDING, GRID, TOP, FLOW, WIDE, RATE])
    + """, snaps as (
  select top.*, flow.signed_volume, flow.abs_volume, flow.trade_count,
         wide.* exclude (symbol, day, ts_ms), rate.funding_rate
  from top join flow using (symbol, day, ts_ms) join wide using (symbol, day, ts_ms)
       join rate using (symbol, day, ts_ms))"""
)


def rounded(cols, digits: int = 6) -> str:
    return ", ".join(f"round({c},{digits}) as {c}" for c in cols)
