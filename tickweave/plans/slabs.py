"""Split, sampling and normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.operators import splits, stats
from tickweave.plans import sqlviews as S
from tickweave.plans import views as V
from tickweave.plans.market import r, snaps
from tickweave.plans.registry import query
from tickweave.session import materialise

_POS = f"""with {S.QUOTES}, x as (
  select *, row_number() over (partition by symbol order by ts_ms, seq)-1 as pos, count(*) over (partition by symbol) as n from q)"""


@query(
    "chrono_split",
    f"{_POS} select symbol, seq, pos, case when pos < floor(n*cast(0.8 as double)) then 'train' else 'eval' end as split from x",
)
def chrono_split(spark, d):
    return splits.chrono_split(V.quotes(spark, d), 0.8, part="day").select("symbol", "seq", "pos", "split")


@query(
    "holdout_split",
    f"{_POS} select symbol, split, count(*) as n_rows, min(pos) as first_pos, max(pos) as last_pos, sum(seq)::bigint as seq_sum from (select *, case when pos >= n-90 then 'holdout' else 'selection' end as split from x) group by 1,2",
)
def holdout_split(spark, d):
    out = splits.holdout_split(V.quotes(spark, d), days=1.5, rows_per_day=60, part="day")
    return out.groupBy("symbol", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.sum("seq").alias("seq_sum"),
    )


@query("tail_rows", f"{_POS} select symbol, seq, pos, bid_px from x where pos >= n-50")
def tail_rows(spark, d):
    return splits.tail_rows(V.quotes(spark, d), 50, part="day").select("symbol", "seq", "pos", "bid_px")


def _draw(n: str, tag: str) -> str:
    return f"(cast('0x'||substr(md5('7|{tag}|'||sample_id),1,15) as bigint) % ({n}))"


@query(
    "window_sample",
    f"""{_POS}, sz as (select symbol, n, row_number() over (order by symbol) as slab, count(*) over () as k
   from (select distinct symbol, n from x where n > 41)),
s0 as (select unnest(generate_series(0,24)) as sample_id),
s1 as (select sample_id, {_draw("(select max(k) from sz)", "slab")}+1 as slab from s0),
s2 as (select sample_id, symbol, {_draw("n-41", "start")} as start from s1 join sz using (slab))
select s2.sample_id, x.symbol, s2.start, x.pos, x.seq, x.bid_px from s2 join x on x.symbol=s2.symbol and x.pos between s2.start and s2.start+39""",
)
def window_sample(spark, d):
    out = splits.sample_windows(V.quotes(spark, d), n_samples=25, length=40, seed=7, part="day")
    return out.select("sample_id", "symbol", "start", "pos", "seq", "bid_px")


FOLD_DAYS = {"train_days": 730, "eval_days": 180, "step_days": 365}
# the windows as rows: they start at the first day of the table and step on as long as one fits
_FOLDS_SQL = """fs as (select i as fold, lo + cast(i*365 as integer) as a from
  (select min(day) as lo, max(day) as hi from tf), generate_series(0, 40) as g(i) where lo + cast(i*365 as integer) + 909 <= hi),
fo as (select fold, 'train' as split, a, a+729 as b from fs union all select fold, 'eval', a+730, a+909 from fs)"""
_TRAIN = """tf as (select l_returnflag as symbol, cast(l_shipdate as date) as day, l_quantity::double as f_quantity,
  l_extendedprice::double as f_price, l_discount::double as f_discount, l_tax::double as f_tax, 7.0::double as f_constant from lineitem)"""


@query(
    "walk_forward_folds",
    f"""with {_TRAIN}, {_FOLDS_SQL},
x as (select fold, split, tf.* from tf join fo on tf.day between fo.a and fo.b union all
  select -1, 'uncovered', tf.* from tf where not exists (select 1 from fo where tf.day between fo.a and fo.b))
select cast(fold as integer) as fold, split, symbol, count(*) as n_rows, round(avg(f_price),4) as mean_price, cast(min(day) as varchar) as first_day,
  cast(max(day) as varchar) as last_day from x group by 1,2,3""",
)
def walk_forward_folds(spark, d):
    """Folds over the whole table, and what lies in no window as a split of its own."""
    df = V.train_frame(spark, d)
    lo, hi = df.agg(F.min("day"), F.max("day")).first()
    folds = splits.make_folds(lo.isoformat(), hi.isoformat(), **FOLD_DAYS)
    inside = splits.walk_forward_folds(df, folds)
    outside = splits.uncovered(df, folds).withColumns({"fold": F.lit(-1), "split": F.lit("uncovered")})
    return inside.unionByName(outside).groupBy("fold", "split", "symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("f_price"), 4).alias("mean_price"),
        F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
    )


TRAIN_END, EVAL_START, FAR = "1998-12-31", "1999-01-01", "2010-01-01"


def _split_frame(spark, d):
    return splits.walk_forward_split(V.train_frame(spark, d), "1990-01-01", TRAIN_END, EVAL_START, FAR)


_STATS = f"""{_TRAIN}, tr as (select * from tf where day <= date '{TRAIN_END}'), ns as (""" + " union all ".join(
    f"""select symbol, '{f}' as feature, avg({f}) as mean,
    case when stddev_pop({f})<1e-8 then 1 else stddev_pop({f}) end as std, count(*) as n from tr group by 1"""
    for f in V.TRAIN_FEATURES
) + ")"


@query("norm_stats", f"with {_STATS} select symbol, feature, round(mean,5) as mean, round(std,5) as std, n from ns")
def norm_stats(spark, d):
    train = _split_frame(spark, d).where("split = 'train'")
    return stats.norm_stats(train, V.TRAIN_FEATURES).select("symbol", "feature", *r(["mean", "std"], 5), "n")


_FOLD_STATS = " union all ".join(
    f"""select fold, symbol, '{f}' as feature, round(avg({f}),5) as mean,
    round(case when stddev_pop({f})<1e-8 then 1 else stddev_pop({f}) end,5) as std, count(*) as n from x group by 1,2"""
    for f in V.TRAIN_FEATURES
)


@query(
    "fold_stats",
    f"""with {_TRAIN}, {_FOLDS_SQL}, x as (select fo.fold, tf.* from tf join fo on tf.day between fo.a and fo.b where split='train')
select cast(fold as integer) as fold, * exclude (fold) from ({_FOLD_STATS})""",
)
def fold_stats(spark, d):
    """Moments of each day are stored once; every fold merges its days."""
    parts = materialise(stats.day_moments(V.train_frame(spark, d), V.TRAIN_FEATURES), "moments")
    lo, hi = parts.agg(F.min("day"), F.max("day")).first()
    folds = splits.make_folds(lo.isoformat(), hi.isoformat(), **FOLD_DAYS)
    return stats.fold_stats(parts, folds).select("fold", "symbol", "feature", *r(["mean", "std"], 5), "n")


_Z = ", ".join(
    f"round(greatest(least((f.{c}-{c}_s.mean)/{c}_s.std,1.5),-1.5),5) as {c}" for c in V.TRAIN_FEATURES
)
_ZJ = " ".join(f"join ns {c}_s on {c}_s.symbol=f.symbol and {c}_s.feature='{c}'" for c in V.TRAIN_FEATURES)


@query(
    "zscore_clip",
    f"""with {_STATS}, z as (select f.symbol, f.day, {_Z} from tf f {_ZJ})
select symbol, cast(day as varchar) as day, {", ".join(V.TRAIN_FEATURES)} from z""",
)
def zscore_clip(spark, d):
    df = V.train_frame(spark, d)
    train = splits.walk_forward_split(df, "1990-01-01", TRAIN_END, EVAL_START, FAR).where("split = 'train'")
    out = stats.apply_stats(df, stats.norm_stats(train, V.TRAIN_FEATURES), V.TRAIN_FEATURES, clip=1.5)
    return out.select("symbol", F.col("day").cast("string").alias("day"), *r(V.TRAIN_FEATURES, 5))


@query("norm_bundle", f"with {_STATS} select symbol, feature, round(mean,5) as mean, round(std,5) as std, n from ns")
def norm_bundle(spark, d):
    train = _split_frame(spark, d).where("split = 'train'")
    records = stats.symbol_records(stats.norm_stats(train, V.TRAIN_FEATURES), V.TRAIN_FEATURES, clip=10.0)
    one = stats.bundle([records], V.TRAIN_FEATURES)
    return stats.unbundle(one, V.TRAIN_FEATURES).select("symbol", "feature", *r(["mean", "std"], 5), "n")


_NF = ("bid_px", "ask_px", "ratio")
_NF_SQL = f"""{_POS}, y as (select *, case when seq%50=3 then 0 else bid_sz/ask_sz end as ratio_clean,
   case when seq%50=3 then null else bid_sz/ask_sz end as ratio, pos < floor(n*cast(0.8 as double)) as tr from x),
st as (select symbol, avg(bid_px) filter (tr) as mb, stddev_pop(bid_px) filter (tr) as sb, avg(ask_px) filter (tr) as ma,
   stddev_pop(ask_px) filter (tr) as sa, count(*) filter (tr) as nt, count(ratio) filter (tr) as nr,
   avg(ratio) filter (tr) as mr, stddev_pop(ratio) filter (tr) as sr from y group by 1)"""


@query(
    "zscore_features",
    f"""{_NF_SQL}
select y.symbol, seq, case when tr then 'train' else 'eval' end as split,
  round(greatest(least((bid_px-mb)/sb,10),-10),5) as bid_px, round(greatest(least((ask_px-ma)/sa,10),-10),5) as ask_px,
  round(case when nr=nt then greatest(least((ratio_clean-mr)/sr,10),-10) else greatest(least(ratio_clean,10),-10) end,5) as ratio
from y join st using (symbol)""",
)
def zscore_features(spark, d):
    q = V.quotes(spark, d)
    # some ratios are infinite: such a feature ends neutral, and the cells become zero
    q = q.withColumn(
        "ratio", F.when(F.col("seq") % 50 == 3, F.lit(float("inf"))).otherwise(F.col("bid_sz") / F.col("ask_sz"))
    )
    out = stats.normalised_features(splits.chrono_split(q, 0.8, part="day"), _NF, dtype="double")
    return out.select("symbol", "seq", "split", *r(_NF, 5))


@query(
    "split_manifest",
    f"""{_POS}, y as (select *, pos < floor(n*cast(0.8 as double)) as tr from x)
select symbol, count(*) filter (tr) as train_rows, count(*) filter (not tr) as eval_rows, min(ts_ms) filter (tr) as train_start_ms,
 max(ts_ms) filter (tr) as train_end_ms, min(ts_ms) filter (not tr) as eval_start_ms, max(ts_ms) filter (not tr) as eval_end_ms,
 cast(0.8 as double) as split_ratio, '0.1.0' as feature_version from y group by 1""",
)
def split_manifest(spark, d):
    out = splits.chrono_split(V.quotes(spark, d), 0.8, part="day")
    m = stats.manifest(out, 0.8, ["bid_px", "ask_px"])
    return m.select(
        "symbol", "train_rows", "eval_rows", "train_start_ms", "train_end_ms", "eval_start_ms", "eval_end_ms",
        "split_ratio", "feature_version",
    )


@query(
    "content_fingerprint",
    f"""with {S.EV}, {S.TRADES} select symbol, count(*) as n_rows,
  cast(sum(cast('0x'||substr(md5(seq||'|'||ts_ms||'|'||cast(quantity as bigint)),1,12) as bigint)) as varchar) as fingerprint
  from t group by 1""",
)
def content_fingerprint(spark, d):
    t = V.trades(spark, d).withColumn("quantity", F.col("quantity").cast("long"))
    return stats.fingerprint(t, ["seq", "ts_ms", "quantity"], ["symbol"], kind="md5")


@query(
    "concat_dedupe",
    f"""with {S.QUOTES}, a as (
  select symbol, ts_ms//60000*60000 as ts_ms, seq, bid_px, ask_px from q
  union all select symbol, ts_ms//60000*60000, seq+1000000000, bid_px+1, ask_px+1 from q),
x as (select *, row_number() over (partition by symbol, ts_ms order by seq) as rn from a)
select symbol, ts_ms, seq, bid_px, round(ask_px,6) as ask_px from x where rn=1""",
)
def concat_dedupe(spark, d):
    q = V.quotes(spark, d).select(
        "symbol", (F.col("ts_ms") - F.col("ts_ms") % 60000).alias("ts_ms"), "seq", "bid_px", "ask_px"
    )
    later = q.withColumns({"seq": F.col("seq") + 1_000_000_000, "bid_px": F.col("bid_px") + 1, "ask_px": F.col("ask_px") + 1})
    return splits.concat_dedupe([q, later]).select("symbol", "ts_ms", "seq", "bid_px", *r(["ask_px"]))


@query(
    "grid_positions",
    f"""with {S.QUOTES}, {S.GRID}, x as (select symbol, day, ts_ms, row_number() over (partition by symbol order by day, ts_ms)-1 as pos from g)
select symbol, cast(day as varchar) as day, ts_ms, pos from x""",
)
def grid_positions(spark, d):
    from tickweave.operators.scan import grid_positions as place

    # counted and numbered, so stored first
    s = materialise(snaps(spark, d, quotes_only=True).select("symbol", "day", "ts_ms"), "ticks")
    return place(s, "symbol", "day", "ts_ms").select("symbol", F.col("day").cast("string").alias("day"), "ts_ms", F.col("pos").cast("long").alias("pos"))


@query(
    "split_order_violations",
    f"""{_POS}, y as (select *, pos < floor(n*cast(0.8 as double)) as tr from x),
b as (select symbol, max(ts_ms) filter (tr) as first_end_ms, min(ts_ms) filter (not tr) as second_start_ms from y group by 1)
select symbol, first_end_ms, second_start_ms, second_start_ms <= first_end_ms as violated from b""",
)
def split_order_violations(spark, d):
    b = materialise(splits.split_bounds(splits.chrono_split(V.quotes(spark, d), 0.8, part="day")), "bounds")
    bad = splits.order_violations(b).select("symbol", F.lit(True).alias("violated"))
    wide = b.groupBy("symbol").agg(
        F.max(F.when(F.col("split") == "train", F.col("end_ms"))).alias("first_end_ms"),
        F.min(F.when(F.col("split") == "eval", F.col("start_ms"))).alias("second_start_ms"),
    )
    return wide.join(bad, "symbol", "left").select(
        "symbol", "first_end_ms", "second_start_ms", F.coalesce("violated", F.lit(False)).alias("violated")
    )
