"""Work plan and raw file scans; the files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.plans import sqlviews as S
from tickweave.plans import views as V
from tickweave.plans.market import day_text, r
from tickweave.plans.registry import query
from tickweave.session import new_path
from tickweave.sources import raw, tables, worklist

_EXISTING = """ex as (select distinct symbol, day, 'quotes' as stream from ev
  union select distinct symbol, day, 'trades' from ev where value > 90)"""


@query(
    "task_plan_pending",
    f"""with {S.EV}, {_EXISTING}, days as (select cast(unnest(generate_series(timestamp '2023-12-28', timestamp '2024-02-04', interval 1 day)) as date) as day),
pl as (select s.symbol, days.day, st.stream from (select distinct symbol from ev) s, days, (select unnest(['quotes','trades','depth']) as stream) st
  where days.day >= case s.symbol when 'click' then date '2024-01-05' when 'view' then date '2023-06-01' else date '1900-01-01' end)
select symbol, cast(day as varchar) as day, stream from pl anti join ex using (symbol, day, stream)""",
)
def task_plan_pending(spark, d):
    e = V.events(spark, d)
    dim = worklist.asset_dimension(spark, {"c": "click", "v": "view"}, {"click": "2024-01-05", "view": "2023-06-01"})
    plan = worklist.task_plan(e, ["quotes", "trades", "depth"], "2023-12-28", "2024-02-04", dim)
    done = e.select("symbol", "day", F.lit("quotes").alias("stream")).unionByName(
        e.where(F.col("value") > 90).select("symbol", "day", F.lit("trades").alias("stream"))
    )
    return worklist.pending(plan, done).select("symbol", day_text(), "stream")


@query(
    "raw_quote_scan",
    f"""with {S.QUOTES} select ts_ms, bid_px, bid_sz, round(ask_px,6) as ask_px, ask_sz from q where seq%61<>0""",
)
def raw_quote_scan(spark, d):
    """Header with blanks and capitals; every 61st price is not a number."""
    path = new_path(spark, "raw-quotes")
    V.quotes(spark, d).select(
        F.col("seq").alias("update_id"),
        F.when(F.col("seq") % 61 == 0, "n/a").otherwise(F.col("bid_px").cast("string")).alias(" Best_Bid_Price"),
        F.col("bid_sz").alias("best_bid_qty"), F.col("ask_px").alias("BEST_ASK_PRICE"), F.col("ask_sz").alias("best_ask_qty"),
        F.col("ts_ms").alias("transaction_time"), F.lit(0).alias("event_time"),
    ).write.option("header", True).option("compression", "gzip").csv(path)
    return raw.parse(spark, "quotes", path).select("ts_ms", "bid_px", "bid_sz", *r(["ask_px"]), "ask_sz")


@query(
    "raw_trade_scan",
    f"""with {S.EV}, {S.TRADES} select ts_ms, price, quantity, is_buyer_maker, signed_qty, n from t, (select unnest([1,2]) as n)""",
)
def raw_trade_scan(spark, d):
    """The same trades from files with and without a header."""
    t = V.trades(spark, d).select(
        F.col("seq").alias("agg_trade_id"), "price", "quantity", F.lit(1).alias("first_trade_id"), F.lit(1).alias("last_trade_id"),
        F.col("ts_ms").alias("transact_time"), "is_buyer_maker",
    )
    out = []
    for n, header in ((1, True), (2, False)):
        path = new_path(spark, "raw-trades")
        t.write.option("header", header).csv(path)
        out.append(raw.parse(spark, "trades", path).withColumn("n", F.lit(n)))
    return out[0].unionByName(out[1])


@query(
    "raw_depth_scan",
    f"""with {S.EV}, {S.DEPTH} select ts_ms//1000*1000 as ts_ms, level/10.0::double as percentage, depth, round(depth*value,6) as notional from d where depth is not null""",
)
def raw_depth_scan(spark, d):
    path = new_path(spark, "raw-depth")
    V.depth(spark, d).select(
        F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "percentage", "depth", "notional"
    ).write.option("header", True).csv(path)
    return raw.parse(spark, "depth", path).select("ts_ms", "percentage", "depth", *r(["notional"]))


@query(
    "stored_day_range",
    f"""with {S.QUOTES} select symbol, cast(day as varchar) as day, count(*) as n_rows, min(ts_ms) as first_ms, round(sum(bid_px),2) as bid_sum
  from q where day between date '2024-01-05' and date '2024-01-20' group by 1,2""",
)
def stored_day_range(spark, d):
    """Written by symbol and day, read back with partition pruning."""
    path = new_path(spark, "quotes")
    tables.write_table(V.quotes(spark, d), path)
    from tickweave import schemas

    t = tables.read_table(spark, path, schemas.QUOTES)
    cut = tables.between_days(t, "2024-01-05", "2024-01-20")
    return cut.groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts_ms").alias("first_ms"), F.round(F.sum("bid_px"), 2).alias("bid_sum")
    ).select("symbol", day_text(), "n_rows", "first_ms", "bid_sum")
