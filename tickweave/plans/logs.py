"""Recorded logs: account columns, reward terms, episode files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.functions import config, rewards
from tickweave.operators import ledger
from tickweave.operators.scan import BLOCK, blocked
from tickweave.plans import sqlviews as S
from tickweave.plans import views as V
from tickweave.plans.market import r
from tickweave.plans.registry import query
from tickweave.session import new_path
from tickweave.sources import logs as L

KEYS, ORDER = ["user_id"], ["ts_ms", "seq"]
_W = "over (partition by user_id order by ts_ms, seq rows unbounded preceding)"
_NAV = f"""{S.EV}, nl as (select user_id, ts_ms, seq, (value-20)/10000 as pnl, event_type='signup' as opened,
  cast(event_type='error' as integer) as cancels from ev),
n1 as (select *, exp(sum(ln(1+pnl)) {_W}) as nav, count(*) filter (pnl<0) {_W} as losses from nl),
n2 as (select *, greatest(1, max(nav) {_W}) as peak_nav, losses-coalesce(max(case when pnl>0 then losses end) {_W},0) as streak from n1),
n3 as (select *, greatest((peak_nav-nav)/peak_nav,0) as drawdown from n2)"""


def nav_rows(spark, d):
    b = blocked(V.nav_log(spark, d), KEYS, ORDER, label="nav")
    return ledger.with_account(b, KEYS, ORDER, F.col("pnl"))


@query(
    "nav_drawdown",
    f"with {_NAV} select user_id, seq, round(nav,8) as nav, round(peak_nav,8) as peak_nav, round(drawdown,8) as drawdown from n3",
)
def nav_drawdown(spark, d):
    return nav_rows(spark, d).select("user_id", "seq", *r(["nav", "peak_nav", "drawdown"], 8))


@query("loss_streaks", f"with {_NAV} select user_id, seq, streak from n3")
def loss_streaks(spark, d):
    return nav_rows(spark, d).select("user_id", "seq", "streak")


_TERMS = f"""{_NAV}, t as (select *, opened or cancels=0 as has_position, pnl*3 as unreal, abs(pnl)/7 as fund, greatest(pnl*3,0)+0.004 as peak from n3),
tt as (select *, case when pnl>=0 then pnl*4.0 else pnl*1.8 end as realised, case when has_position then unreal*0.3 else 0 end as open_value,
  -50.0*pow(greatest(drawdown-0.03,0),2) as dd, case when opened then -0.05*greatest(streak-2,0) else 0 end as streak_t,
  case when has_position then -0.01*abs(fund) else 0 end as funding, case when opened then -0.02 else 0 end as entry,
  -0.005*greatest(cancels,0) as churn, case when has_position then -0.5*greatest(peak-unreal-0.005,0) else 0 end as give_back from t),
rw as (select *, greatest(realised+open_value+dd+streak_t+funding+entry+churn+give_back, -5) as reward from tt)"""


def _with_rewards(spark, d):
    # the term takes the name "streak", so the count needs another
    rows = nav_rows(spark, d).withColumnRenamed("streak", "losses_in_row")
    c = F.col
    return rewards.with_rewards(
        rows, pnl=c("pnl"), unrealised=c("pnl") * 3, has_position=c("opened") | (c("cancels") == 0), drawdown=c("drawdown"),
        streak=c("losses_in_row"), opened=c("opened"), funding=F.abs("pnl") / 7, cancels=c("cancels"),
        peak=F.greatest(c("pnl") * 3, F.lit(0.0)) + 0.004,
    )


_NAMES = dict(zip(rewards.TERMS, ["realised", "open_value", "dd", "streak_t", "funding", "entry", "churn", "give_back"]))


@query(
    "reward_attribution",
    f"with {_TERMS} " + " union all ".join(f"select user_id, '{k}' as term, round(sum({v}),9)+0.0::double as total from rw group by 1" for k, v in _NAMES.items()),
)
def reward_attribution(spark, d):
    out = rewards.attribution(_with_rewards(spark, d), ["user_id"])
    return out.select("user_id", "term", (F.round("total", 9) + F.lit(0.0)).alias("total"))


@query("reward_rows", f"with {_TERMS} select user_id, seq, round(reward,8) as reward from rw")
def reward_rows(spark, d):
    return _with_rewards(spark, d).select("user_id", "seq", *r(["reward"], 8))


@query(
    "new_best",
    f"""with {S.EV}, x as (select user_id, seq, value, max(value) over (partition by user_id order by ts_ms, seq
  rows between unbounded preceding and 1 preceding) as best from ev)
select user_id, seq, value > coalesce(best, cast('-infinity' as double)) as new_best from x""",
)
def new_best(spark, d):
    b = blocked(V.events(spark, d).select("user_id", "ts_ms", "seq", "value"), KEYS, ORDER, label="best")
    return ledger.with_new_best(b, KEYS, ORDER, F.col("value")).select("user_id", "seq", "new_best")


_K = "over (partition by symbol order by ts_ms, seq rows between 2 preceding and current row)"


@query(
    "breach_runs",
    f"""with {S.EV}, x as (select symbol, seq, count(*) {_K} as n, min(value) {_K} as lo, max(value) {_K} as hi from ev)
select symbol, seq, n=3 and (lo>60 or hi<5) as breach from x""",
)
def breach_runs(spark, d):
    b = blocked(V.events(spark, d).select("symbol", "ts_ms", "seq", "value"), ["symbol"], ORDER, label="breach")
    out = ledger.with_breach_runs(b, ["symbol"], ORDER, F.col("value"), hi=60.0, lo=5.0, k=3)
    return out.select("symbol", "seq", "breach")


def _eval_log(spark, d):
    """Evaluation logs as nested JSON, one record per event, in the trainer's shape."""
    e = V.events(spark, d)
    steps = F.sequence(F.lit(1), (1 + F.col("event_id") % 5).cast("int"))
    episode = F.struct(
        (F.col("event_id") % 3).cast("int").alias("episode_idx"),
        F.size(steps).alias("n_steps"),
        F.transform(steps, lambda i: (i % 5).cast("int")).alias("actions"),
        F.transform(steps, lambda i: F.round(F.col("value") * i / 100.0, 6)).alias("rewards"),
        F.transform(steps, lambda i: F.array(i.cast("double"), F.col("value"))).alias("obs_history"),
    )
    return e.select(
        F.concat(F.lit("run-"), F.col("user_id")).alias("run_id"), F.col("event_id").alias("eval_idx"),
        F.col("ts_ms").alias("num_timesteps"), F.array(episode).alias("episodes"),
    )


_STEPS = f"""{S.EV}, st as (select 'run-'||user_id as run_id, event_id as eval_idx, cast(event_id%3 as integer) as episode_idx, i as step,
  cast(i%5 as integer) as action, round(value*i/100.0,6) as reward from (select *, unnest(generate_series(1, 1+event_id%5)) as i from ev))"""


@query("episode_json_flatten", f"with {_STEPS} select run_id, eval_idx, episode_idx, step-1 as step, action, reward from st")
def episode_json_flatten(spark, d):
    path = new_path(spark, "eval-log")
    _eval_log(spark, d).write.json(path)
    return L.episode_steps(L.read_eval_logs(spark, path)).select("run_id", "eval_idx", "episode_idx", "step", "action", "reward")


@query(
    "episode_totals",
    f"with {_STEPS} select run_id, eval_idx, episode_idx, round(sum(reward),5) as cum_reward, count(*) as n_steps from st group by 1,2,3",
)
def episode_totals(spark, d):
    path = new_path(spark, "eval-log")
    _eval_log(spark, d).write.json(path)
    t = L.episode_totals(L.episode_steps(L.read_eval_logs(spark, path)))
    return t.select("run_id", "eval_idx", "episode_idx", *r(["cum_reward"], 5), "n_steps")


@query(
    "json_path_metric",
    """select event_type, count(*) as n, sum(cast(json_extract(props,'$.k') as bigint))::bigint as k_sum,
  max(cast(json_extract(props,'$.k') as bigint)) as k_max from events group by 1""",
)
def json_path_metric(spark, d):
    e = V.table(spark, d, "events").withColumn("k", config.json_path("props", "k").cast("long"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


@query(
    "settings_override",
    """select event_id, cast(json_extract(props,'$.k') as varchar) as stage_k, 'fixed' as mode, case when event_type='error' then '0' else '1' end as vec_n,
  case when event_type='error' then 2 else 3 end as n_keys from events""",
)
def settings_override(spark, d):
    e = V.table(spark, d, "events")
    base = F.create_map(
        F.lit("stage.k"), F.lit("none"), F.lit("mode"), F.lit("fixed"), F.lit("vec.n"), F.lit("1"),
    )
    over = F.create_map(F.lit("stage.k"), config.json_path("props", "k"))
    # on errors a plain value replaces the whole "vec" section
    over = F.when(F.col("event_type") == "error", F.map_concat(over, F.create_map(F.lit("vec"), F.lit("0")))).otherwise(over)
    m = config.merge_settings(base, over)
    n = F.coalesce(config.setting(m, "vec.n"), config.setting(m, "vec"))
    return e.select(
        "event_id", config.setting(m, "stage.k").alias("stage_k"), config.setting(m, "mode").alias("mode"), n.alias("vec_n"),
        (F.size(m) - F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("n_keys"),
    )
