"""Score tables: summaries, rankings, rank tests, parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.functions.arrays import normalised_entropy, softmax
from tickweave.operators import gates
from tickweave.plans import views as V
from tickweave.plans.market import r
from tickweave.plans.registry import query
from tickweave.session import materialise

_REWARDS = """rw as (select o_orderpriority as candidate, o_orderkey as episode, (o_totalprice-200000)/20000 as reward,
  case when o_orderstatus='F' and o_orderpriority in ('4-NOT SPECIFIED','5-LOW') then 1000+o_orderkey%8000 else 9000 end as length from orders)"""
_SUMMARY = f"""{_REWARDS}, sm as (select candidate, count(*) as n_episodes, avg(reward) as mean_reward, stddev_pop(reward) as std_reward,
  min(reward) as min_reward, max(reward) as max_reward, quantile_cont(reward,0.5) as median_reward, quantile_cont(reward,0.05) as p5_reward,
  quantile_cont(reward,0.95) as p95_reward, avg((length>=9000)::integer) as ep_survival, avg(length) as mean_length,
  quantile_cont(length,0.5) as median_length from rw group by 1)"""
_METRICS = ("mean_reward", "std_reward", "min_reward", "max_reward", "median_reward", "p5_reward", "p95_reward", "ep_survival", "mean_length", "median_length")


@query("reward_summary", f"with {_SUMMARY} select candidate, n_episodes, {', '.join(f'round({m},5) as {m}' for m in _METRICS)} from sm")
def reward_summary(spark, d):
    return gates.score_summary(V.rewards(spark, d)).select("candidate", "n_episodes", *r(_METRICS, 5))


@query(
    "reward_summary_sketch",
    f"""with {_REWARDS} select candidate, count(*) as n_episodes, round(avg(reward),5) as mean_reward, min(reward) as min_reward,
  max(reward) as max_reward, true as median_within, true as p5_within, true as p95_within from rw group by 1""",
)
def reward_summary_sketch(spark, d):
    """Stored sketches of 16 batches, merged; the exact rank of every quantile is within 1 % of what was asked."""
    rows = V.rewards(spark, d)
    batches = rows.withColumn("batch", F.pmod("episode", F.lit(16)))
    stored = materialise(gates.score_sketches(batches, ("candidate", "batch")), "sketches")
    got = gates.sketch_summary(gates.merged_sketches(stored))
    asked = {"median": 0.5, "p5": 0.05, "p95": 0.95}
    ranks = []
    for name in asked:
        at = F.col(f"{name}_reward")
        ranks += [F.avg((F.col("reward") < at).cast("double")).alias(f"{name}_below")]
        ranks += [F.avg((F.col("reward") <= at).cast("double")).alias(f"{name}_upto")]
    exact = rows.join(got.select("candidate", *[f"{n}_reward" for n in asked]), "candidate").groupBy("candidate").agg(*ranks)
    within = [
        ((F.col(f"{n}_below") - 0.01 <= q) & (F.col(f"{n}_upto") + 0.01 >= q)).alias(f"{n}_within") for n, q in asked.items()
    ]
    return got.join(exact, "candidate").select("candidate", "n_episodes", *r(["mean_reward"], 5), "min_reward", "max_reward", *within)


_PASS = "mean_reward>2 and median_reward>0 and ep_survival>0.9 and p5_reward>-15"


@query(
    "rubric_rank",
    f"""with {_SUMMARY}, g as (select *, {_PASS} as passes_rubric from sm)
select candidate, round(mean_reward,5) as mean_reward, round(p5_reward,5) as p5_reward, passes_rubric,
  (mean_reward>2)::integer+(median_reward>0)::integer+(ep_survival>0.9)::integer+(p5_reward>-15)::integer as n_passed,
  cast(row_number() over (order by passes_rubric desc, mean_reward desc nulls last, candidate) as integer) as rank from g""",
)
def rubric_rank(spark, d):
    g = gates.rank_candidates(gates.rubric(gates.score_summary(V.rewards(spark, d))))
    passed = F.aggregate("rubric_breakdown", F.lit(0), lambda n, m: n + F.when(m["pass"], 1).otherwise(0))
    return g.select("candidate", *r(["mean_reward", "p5_reward"], 5), "passes_rubric", passed.alias("n_passed"), "rank")


@query(
    "sweep_topn",
    """select c_custkey as run, case when c_custkey%13<>0 then c_acctbal end as metric from customer where c_mktsegment='BUILDING'
order by metric desc nulls last, run limit 20""",
)
def sweep_topn(spark, d):
    return gates.top_runs(V.sweep_runs(spark, d), 20, finished="BUILDING").select("run", "metric")


@query(
    "pos_rate",
    f"""with {_REWARDS} select candidate, count(*) as n_episodes, round(avg((reward>0)::integer),8) as positive_rate, round(avg(reward),6) as mean_reward,
  round(stddev_samp(reward),6) as stdev_reward from rw group by 1""",
)
def pos_rate(spark, d):
    p = gates.positive_rate(V.rewards(spark, d))
    return p.select("candidate", "n_episodes", *r(["positive_rate"], 8), *r(["mean_reward", "stdev_reward"]))


# complementary error function by its Chebyshev fit, good to 1.2e-7, for engines without erf
_T = "(1.0::double/(1.0+0.5*abs(z)/sqrt(2.0)))"
_COEF = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
_POLY = repr(_COEF[-1])
for _c in reversed(_COEF[:-1]):
    _POLY = f"({_c}+{_T}*{_POLY})"
_ERFC = f"({_T}*exp(-z*z/2.0+{_POLY}))"
_P = f"(case when z>=0 then 0.5*{_ERFC} else 1-0.5*{_ERFC} end)"
_BASE = "5-LOW"
_MW = f"""{_REWARDS}, pairs as (select c.candidate, b.reward, b.candidate=c.candidate as mine from rw b join (select distinct candidate from rw where candidate<>'{_BASE}') c
   on b.candidate=c.candidate or b.candidate='{_BASE}'),
rk as (select *, rank() over (partition by candidate order by reward) + (count(*) over (partition by candidate, reward)-1)/2.0::double as rk,
   count(*) over (partition by candidate, reward) as t from pairs),
ag as (select candidate, count(*) filter (mine) as n, count(*) filter (not mine) as n_baseline, sum(rk) filter (mine) as r1,
   sum((t*t-1)::double) as ties from rk group by 1),
us as (select *, r1-n*(n+1)/2.0::double as u from ag),
zs as (select *, (u-n::double*n_baseline/2-0.5)/sqrt(n::double*n_baseline/12*((n+n_baseline+1)-ties/((n+n_baseline)::double*(n+n_baseline-1)))) as z from us),
mw as (select candidate, n, n_baseline, u, z, {_P} as p_value from zs)"""


def _tests(spark, d):
    rw = V.rewards(spark, d)
    return gates.rank_test(rw.where(F.col("candidate") != _BASE), rw.where(F.col("candidate") == _BASE))


@query(
    "mann_whitney_u",
    f"with {_MW} select candidate, n, n_baseline, u, round(z,6) as z, round(p_value,5) as p_value, p_value<0.01 as passed from mw",
)
def mann_whitney_u(spark, d):
    t = _tests(spark, d)
    return t.select("candidate", "n", F.col("n_baseline").cast("long").alias("n_baseline"), "u", *r(["z"]), *r(["p_value"], 5), "passed")


@query("mann_whitney_gate", f"with {_MW} select count(*) as n_candidates, bool_and(p_value<0.01) as all_passed, count(*)<3 as low_power from mw")
def mann_whitney_gate(spark, d):
    return gates.gate_verdict(_tests(spark, d))


_SOFT = """sx as (select vec_id as obs_id, list_transform(embedding, lambda x: exp(x::double*20)) as ex from embeddings),
pr as (select obs_id, list_transform(ex, lambda x: x/list_sum(ex)) as p from sx),
cl as (select obs_id, list_transform(p, lambda x: least(greatest(x,1e-12),1)) as p from pr),
nz as (select obs_id, list_transform(p, lambda x: x/list_sum(p)) as p from cl),
en as (select obs_id, -list_sum(list_transform(p, lambda x: x*ln(x)))/ln(64) as entropy from nz)"""


@query("entropy_rows", f"with {_SOFT} select obs_id, round(entropy,8) as entropy from en")
def entropy_rows(spark, d):
    lg = V.logits(spark, d)
    probs = softmax(F.transform("scores", lambda x: x * 20))
    return lg.select("obs_id", F.round(normalised_entropy(probs, 64), 8).alias("entropy"))


_PERT = "list_transform(embedding, lambda x, i: x::double + ((vec_id+i)%7-3)*cast(0.00001 as double))"


@query(
    "score_parity",
    f"""with x as (select vec_id, list_transform(embedding, lambda x: x::double) as a, {_PERT} as b from embeddings),
y as (select *, list_transform(list_zip(a,b), lambda z: abs(z[1]-z[2])) as df,
  list_position(a, list_max(a))=list_position(b, list_max(b)) as same from x)
select count(*) as n_obs, round(max(list_max(df)),9) as max_diff, round(sum(list_sum(df))/sum(len(df)),9) as mean_diff,
  bool_and(same) as action_match, max(list_max(df))<1e-4 and bool_and(same) as passed from y""",
)
def score_parity(spark, d):
    a = V.logits(spark, d)
    shift = F.transform("scores", lambda x, i: x + ((F.col("obs_id") + i + 1) % 7 - 3) * F.lit(0.00001))
    b = a.select("obs_id", shift.alias("scores"))
    v = gates.parity_verdict(gates.score_parity(a, b))
    return v.select("n_obs", *r(["max_diff", "mean_diff"], 9), "action_match", "passed")


@query(
    "parity_rows",
    f"""with x as (select vec_id, list_transform(embedding, lambda x: x::double) as a, {_PERT} as b from embeddings)
select vec_id as obs_id, cast(list_position(a, list_max(a))-1 as integer) as choice_a, cast(list_position(b, list_max(b))-1 as integer) as choice_b,
  round(list_max(list_transform(list_zip(a,b), lambda z: abs(z[1]-z[2]))),9) as max_diff from x""",
)
def parity_rows(spark, d):
    from tickweave.functions.arrays import argmax

    a = V.logits(spark, d)
    shift = F.transform("scores", lambda x, i: x + ((F.col("obs_id") + i + 1) % 7 - 3) * F.lit(0.00001))
    b = a.select("obs_id", shift.alias("scores"))
    rows = gates.score_parity(a, b)
    choices = a.select("obs_id", argmax(F.col("scores")).alias("choice_a")).join(
        b.select("obs_id", argmax(F.col("scores")).alias("choice_b")), "obs_id"
    )
    return rows.join(choices, "obs_id").select("obs_id", "choice_a", "choice_b", *r(["max_diff"], 9))
