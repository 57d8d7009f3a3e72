"""Files, tables and records written from the given tables and read back, and checks on their shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.operators import quality, splits, stats
from tickweave.plans import sqlviews as S
from tickweave.plans import views as V
from tickweave.plans.market import day_text, r
from tickweave.plans.registry import query
from tickweave.session import new_path
from tickweave.sources import commits, logs, raw, tables, worklist


@query(
    "raw_quote_mixed_headers",
    f"""with {S.QUOTES} select ts_ms, bid_px, bid_sz, round(ask_px,6) as ask_px, ask_sz from q""",
)
def raw_quote_mixed_headers(spark, d):
    """One job over files whose headers order and name their columns differently."""
    path = new_path(spark, "raw-quotes")
    q = V.quotes(spark, d)
    odd = F.col("seq") % 2 == 1
    q.where(odd).select(
        F.col("bid_px").alias("best_bid_price"), F.col("bid_sz").alias("best_bid_qty"), F.col("ask_px").alias("best_ask_price"),
        F.col("ask_sz").alias("best_ask_qty"), F.col("ts_ms").alias("transaction_time"),
    ).write.option("header", True).csv(f"{path}/a")
    q.where(~odd).select(
        F.col("ts_ms").alias("Event_Time"), F.col("ask_sz").alias("best_ask_qty"), F.col("ask_px").alias("BEST_ASK_PRICE"),
        F.col("seq").alias("update_id"), F.col("bid_sz").alias("best_bid_qty"), F.col("bid_px").alias("best_bid_price"),
    ).write.option("header", True).option("compression", "gzip").csv(f"{path}/b")
    got = raw.parse(spark, "quotes", [f"{path}/a", f"{path}/b"])
    return got.select("ts_ms", "bid_px", "bid_sz", *r(["ask_px"]), "ask_sz")


@query(
    "raw_trade_header_order",
    f"""with {S.EV}, {S.TRADES} select ts_ms, price, quantity, is_buyer_maker, signed_qty from t""",
)
def raw_trade_header_order(spark, d):
    path = new_path(spark, "raw-trades")
    V.trades(spark, d).select(
        "quantity", "is_buyer_maker", F.col("ts_ms").alias("transact_time"), "price", F.col("seq").alias("agg_trade_id")
    ).write.option("header", True).csv(path)
    return raw.parse(spark, "trades", path)


@query(
    "parse_report_rows",
    f"""with {S.EV}, {S.TRADES} select 'ok' as status, count(*) as n_rows, count(*) filter (seq%7<>0 and seq%5<>0) as n_kept,
  count(*) filter (seq%7=0) as n_bad_time, count(*) filter (seq%7<>0 and seq%5=0) as n_bad_value from t""",
)
def parse_report_rows(spark, d):
    """Rows kept and dropped by cause; files are summed, as their number is the writer's choice."""
    path = new_path(spark, "raw-trades")
    text = F.col("ts_ms").cast("string")
    V.trades(spark, d).select(
        F.col("seq").alias("agg_trade_id"), F.when(F.col("seq") % 5 == 0, "ten").otherwise(F.col("price").cast("string")).alias("price"),
        "quantity", F.lit(1).alias("first_trade_id"), F.lit(1).alias("last_trade_id"),
        F.when(F.col("seq") % 7 == 0, "oops").otherwise(text).alias("transact_time"), "is_buyer_maker",
    ).write.csv(path)
    # a writer without rows leaves a file without lines, which has nothing to report
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"))
    files = sorted(x.file for x in lines.distinct().collect())
    report = raw.parse_report(spark, "trades", files)
    return report.groupBy("status").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_kept", "n_bad_time", "n_bad_value")])


@query(
    "reward_file_rows",
    f"""with {S.EV} select symbol as policy, cast(user_id%3 as bigint) as seed, row_number() over (partition by symbol, user_id%3 order by seq)-1 as episode,
  value as reward, case when user_id%3<>1 then seq%100 end as length from ev""",
)
def reward_file_rows(spark, d):
    """Reward files of every policy and seed, at most 10,000 episodes each; one seed has no lengths."""
    path = new_path(spark, "rewards")
    e = V.events(spark, d).select(F.col("symbol").alias("policy"), (F.col("user_id") % 3).cast("long").alias("seed"), "seq", "value")
    placed = splits.positions(e, ["policy", "seed"], ["seq"])
    first = (F.floor(F.col("pos") / 10_000) * 10_000).alias("first_episode")
    kept = F.sort_array(F.collect_list(F.struct("seq", "value", (F.col("seq") % 100).alias("length"))))
    files = placed.groupBy("policy", "seed", first).agg(kept.alias("k")).select(
        "policy", "seed", "first_episode", F.col("k.value").alias("rewards"),
        F.when(F.col("seed") != 1, F.col("k.length")).alias("episode_lengths"),
    )
    files.write.json(path)
    return logs.read_rewards(spark, path, multiline=False).select("policy", "seed", "episode", "reward", "length")


@query(
    "latest_version_rows",
    f"""with {S.EV}, {S.FUNDING} select symbol, ts_ms, round(funding_rate*3,8) as funding_rate from f""",
)
def latest_version_rows(spark, d):
    """The last of three versions of the rates, by file name."""
    path = new_path(spark, "rates")
    f = V.funding(spark, d).select("symbol", "ts_ms", "funding_rate")
    for i in (1, 2, 3):
        f.withColumn("funding_rate", F.col("funding_rate") * i).coalesce(1).write.parquet(f"{path}/{i}")
    files = [sorted(spark.read.parquet(f"{path}/{i}").inputFiles())[0] for i in (1, 2, 3)]
    # the writer names files at random, so the newest name is looked up in the same order
    newest = max(range(3), key=lambda i: files[i].rsplit("/", 1)[-1])
    got = tables.latest_version(spark, f"{path}/*/*.parquet")
    return got.select("symbol", "ts_ms", F.round(F.col("funding_rate") / (newest + 1) * 3, 8).alias("funding_rate"))


@query(
    "stored_records",
    f"""with {S.EV} select symbol, count(*) as n, round(avg(value),5) as mean from ev group by 1""",
)
def stored_records(spark, d):
    path = new_path(spark, "records")
    e = V.events(spark, d)
    logs.write_records(e.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean")), path)
    return spark.read.schema("symbol string, n long, mean double").json(path)


@query(
    "mirror_gaps",
    f"""with {S.QUOTES} select distinct symbol, cast(day as varchar) as day from q where symbol='click' or day<date '2024-01-10'""",
)
def mirror_gaps(spark, d):
    """Days of a stored table that its mirror lacks; the mirror holds the later days of all symbols but one."""
    source, target = new_path(spark, "source"), new_path(spark, "target")
    q = V.quotes(spark, d)
    later = (F.col("symbol") != "click") & (F.col("day") >= F.lit("2024-01-10").cast("date"))
    tables.write_table(q, source)
    tables.write_table(q.where(later), target)

    def days(path):
        # file names are the writer's; a day's folder is what both sides share
        folder = F.regexp_extract("key", r"(symbol=[^/]+/day=[^/]+)/", 1)
        return tables.listing(spark, path, ".parquet").select(F.concat(F.lit(f"{path}/"), folder).alias("key")).distinct()

    gone = tables.not_mirrored(days(source), days(target), source, target)
    return gone.select(
        F.regexp_extract("name", "symbol=([^/]+)", 1).alias("symbol"), F.regexp_extract("name", "day=([^/]+)", 1).alias("day")
    )


@query(
    "content_hash_rows",
    f"""with {S.EV} select seq, substr(sha256(concat_ws('|', symbol, cast(seq as varchar), cast(user_id as varchar))),1,16) as hash from ev""",
)
def content_hash_rows(spark, d):
    parts = [F.col("symbol"), F.col("seq").cast("string"), F.col("user_id").cast("string")]
    return V.events(spark, d).select("seq", schemas.content_hash(*parts).alias("hash"))


@query("named_slabs", f"""with {S.QUOTES} select symbol, count(*) as n, min(ts_ms) as first_ms from q where symbol in ('click','view') group by 1""")
def named_slabs(spark, d):
    q = tables.columns(V.quotes(spark, d), ["symbol", "ts_ms"])
    two = tables.select_symbols(q, ["click", "view"])
    return two.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"))


@query("first_rows_sample", f"""with {S.QUOTES} select symbol, ts_ms, seq, bid_px from q order by ts_ms, seq limit 100""")
def first_rows_sample(spark, d):
    return tables.first_rows(V.quotes(spark, d), 100, ("ts_ms", "seq")).select("symbol", "ts_ms", "seq", "bid_px")


@query(
    "schema_issues",
    f"""with {S.QUOTES}, k as (select distinct symbol, day from q), c as (select unnest(['ask_sz','bid_sz']) as c)
select symbol, cast(day as varchar) as day, 'quotes' as stream, 'ERROR' as severity, 'missing column '||c as "check", cast(1 as bigint) as n from k, c""",
)
def schema_issues(spark, d):
    q = V.quotes(spark, d).drop("ask_sz", "bid_sz")
    out = quality.schema_issues(q, schemas.QUOTES.names, "quotes")
    return out.select("symbol", day_text(), "stream", F.upper("severity").alias("severity"), "check", "n")


@query(
    "empty_day_issues",
    f"""with {S.QUOTES}, k as (select distinct symbol, day from q), h as (select distinct symbol, day from q where seq%997=0)
select symbol, cast(day as varchar) as day, 'empty' as "check", cast(1 as bigint) as n from k anti join h using (symbol, day)""",
)
def empty_day_issues(spark, d):
    q = V.quotes(spark, d)
    out = quality.empty_days(q.select("symbol", "day").distinct(), q.where(F.col("seq") % 997 == 0), "quotes", quality.ERROR)
    return out.select("symbol", day_text(), "check", "n")


@query(
    "short_slabs",
    f"""with {S.EV} select user_id, cast(day as varchar) as day, count(*) as n_rows from ev group by 1,2 having count(*) <= 2""",
)
def short_slabs(spark, d):
    return quality.require_min_rows(V.events(spark, d), 2, ("user_id", "day")).select("user_id", day_text(), "n_rows")


@query(
    "checked_feature_rows",
    f"""with {S.QUOTES} select symbol, count(*) as n, round(sum(bid_px),2) as total, '{schemas.FEATURE_VERSION}' as feature_version from q group by 1""",
)
def checked_feature_rows(spark, d):
    """Rows that pass the finiteness and the version check, which stop the job otherwise."""
    q = V.quotes(spark, d).withColumn("feature_version", F.lit(schemas.FEATURE_VERSION))
    q = schemas.require_version(quality.require_finite(q, ["bid_px", "ask_px"]))
    return q.groupBy("symbol", "feature_version").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("bid_px"), 2).alias("total"))


@query(
    "row_fingerprints",
    """with e as (select event_type as symbol, event_id, value from events)
select symbol, count(*) as n_rows from e group by 1""",
)
def row_fingerprints(spark, d):
    """The default fingerprint does not depend on the order or the partitions of the rows."""
    e = V.events(spark, d).select("symbol", "event_id", "value")
    one = stats.fingerprint(e, ["event_id", "value"], ["symbol"])
    two = stats.fingerprint(e.repartition(7, "value"), ["event_id", "value"], ["symbol"])
    return one.join(two, ["symbol", "n_rows", "fingerprint"]).select("symbol", "n_rows")


@query(
    "stored_counts",
    f"""with {S.QUOTES} select symbol, cast(day as varchar) as day, count(*) as n_rows, min(ts_ms) as min_ts_ms, max(ts_ms) as max_ts_ms,
  min(bid_px) as min_bid_px, max(bid_px) as max_bid_px from q group by 1,2""",
)
def stored_counts(spark, d):
    """Rows and ranges of every stored day, from the footers alone."""
    path = new_path(spark, "quotes")
    tables.write_table(V.quotes(spark, d), path)
    return tables.footer_facts(spark, path, ["ts_ms", "bid_px"]).withColumn("day", day_text())


def _commits(spark, d):
    """All days; then 'click' doubled from the 10th on; then a run of 'view' that is stopped before its commit."""
    root, q = new_path(spark, "committed"), V.quotes(spark, d)
    late = F.col("day") >= F.lit("2024-01-10").cast("date")
    commits.write_committed(q.where((F.col("symbol") != "purchase") | ~late), root)
    commits.write_committed(q.where((F.col("symbol") == "click") & late).withColumn("bid_px", F.col("bid_px") * 2), root)
    commits.stage(q.where((F.col("symbol") == "view") | ((F.col("symbol") == "purchase") & late)).withColumn("bid_px", F.lit(0.0)), root)
    return root, q


@query(
    "committed_days",
    f"""with {S.QUOTES} select symbol, cast(day as varchar) as day, count(*) as n_rows,
  round(sum(bid_px * case when symbol='click' and day>=date '2024-01-10' then 2 else 1 end),4) as total
from q where symbol<>'purchase' or day<date '2024-01-10' group by 1,2""",
)
def committed_days(spark, d):
    root, q = _commits(spark, d)
    got = commits.read_committed(spark, root, q.schema)
    out = got.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("bid_px"), 4).alias("total"))
    return out.withColumn("day", day_text())


@query(
    "committed_pending",
    f"""with {S.QUOTES} select distinct symbol, cast(day as varchar) as day from q where symbol='purchase' and day>=date '2024-01-10'""",
)
def committed_pending(spark, d):
    """Days that only an uncommitted run has written are still to be done."""
    root, q = _commits(spark, d)
    plan = q.select("symbol", "day").distinct()
    return worklist.pending(plan, commits.committed(spark, root, q.schema), keys=("symbol", "day")).withColumn("day", day_text())
