"""Score summaries, rank tests and ship-or-not gates."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tickweave.functions.arrays import abs_differences, argmax, array_sum
from tickweave.operators.scan import Running, blocked, positions, scan
from tickweave.operators.splits import with_positions

# Thresholds of the rubric, all strict, and the full episode length.
RUBRIC = {"mean_reward": 2.0, "median_reward": 0.0, "ep_survival": 0.90, "p5_reward": -15.0}
FULL_LENGTH = 9000
ALPHA = 0.01
MIN_CANDIDATES = 3
PARITY_TOLERANCE = 1e-4


def quantile_columns(value: str, qs: dict[str, float], pos="pos", total="n_total") -> list[Column]:
    """Linear-interpolation quantiles from positions: at most two rows carry each of them."""
    out = []
    for name, q in qs.items():
        h = (F.col(total) - 1) * F.lit(float(q))
        lo = F.floor(h)
        frac = h - lo
        x = F.col(value)
        share = F.when(F.col(pos) == lo, x * (1 - frac)).when(F.col(pos) == lo + 1, x * frac)
        out.append(F.sum(share).alias(name))
    return out


def score_summary(
    df: DataFrame, by=("candidate",), value="reward", length="length", tie="episode", full=FULL_LENGTH, blocks=None
) -> DataFrame:
    """Mean, population deviation, exact quantiles, range, survival and length figures.

    Quantiles come from sorted positions, so no group is held in one buffer. Rows without
    a value count in none of the figures; rows without a length not in those of lengths.
    """
    by = list(by)
    scored = df.where(F.col(value).isNotNull())
    placed = with_positions(scored, by, [value, tie], blocks)
    x = F.col(value)
    out = placed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.avg(x).alias("mean_reward"),
        F.stddev_pop(x).alias("std_reward"),
        F.min(x).alias("min_reward"),
        F.max(x).alias("max_reward"),
        *quantile_columns(value, {"median_reward": 0.5, "p5_reward": 0.05, "p95_reward": 0.95}),
        *(
            [F.avg((F.col(length) >= full).cast("double")).alias("ep_survival"), F.avg(length).alias("mean_length")]
            if length
            else []
        ),
    )
    if not length:
        return out
    known = scored.where(F.col(length).isNotNull()).select(*by, length, tie)
    mid = with_positions(known, by, [length, tie], blocks)
    return out.join(mid.groupBy(*by).agg(*quantile_columns(length, {"median_length": 0.5})), by, "left")


def score_sketches(df: DataFrame, by=("candidate",), value="reward", k: int = 1000) -> DataFrame:
    """Moments and a quantile sketch of the scores of each group; ``by`` may hold a batch or a day, to be merged later.

    The rank of a quantile is off by about ``2.3 / k ** 0.97`` (0.3 % at 1000) at most, with 99 %
    confidence, whatever the number of rows; a sketch takes about ``30 k`` bytes. Nulls don't count.
    """
    x = F.col(value)
    return df.where(x.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_episodes"), F.sum(x).alias("sum_reward"), F.min(x).alias("min_reward"),
        F.max(x).alias("max_reward"), F.kll_sketch_agg_double(x.cast("double"), k).alias("sketch"),
    )


def merged_sketches(sketches: DataFrame, by=("candidate",)) -> DataFrame:
    """Sketches of finer groups merged; only sketches travel, never scores."""
    return sketches.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n_episodes", "sum_reward")], F.min("min_reward").alias("min_reward"),
        F.max("max_reward").alias("max_reward"), F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def sketch_summary(sketches: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Mean, range and approximate ``quantiles`` of each sketch; the exact figures are ``score_summary``'s."""
    wanted = quantiles or {"median_reward": 0.5, "p5_reward": 0.05, "p95_reward": 0.95}
    out = sketches.withColumn("mean_reward", F.col("sum_reward") / F.col("n_episodes"))
    cols = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for name, q in wanted.items()}
    return out.withColumns(cols).drop("sketch", "sum_reward")


def positive_rate(df: DataFrame, by=("candidate",), value="reward") -> DataFrame:
    x = F.col(value)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_episodes"), F.avg((x > 0).cast("double")).alias("positive_rate"),
        F.avg(x).alias("mean_reward"), F.stddev_samp(x).alias("stdev_reward"),
    )


def rubric(summary: DataFrame, thresholds: dict[str, float] = RUBRIC) -> DataFrame:
    """``passes_rubric`` and the per-metric breakdown; failed candidates (null metrics) do not pass."""
    ok = {m: F.coalesce(F.col(m) > t, F.lit(False)) for m, t in thresholds.items()}
    passes = F.lit(True)
    for c in ok.values():
        passes = passes & c
    parts = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("threshold"), ok[m].alias("pass"))
        for m, t in thresholds.items()
    ]
    return summary.withColumns({"passes_rubric": passes, "rubric_breakdown": F.array(*parts)})


def rank_candidates(graded: DataFrame, by="candidate") -> DataFrame:
    """Passers first, then by mean with missing means last; the rank is a position of a distributed sort."""
    keyed = graded.withColumns(
        {"_f": ~F.col("passes_rubric"), "_n": F.col("mean_reward").isNull(), "_m": -F.coalesce("mean_reward", F.lit(0.0))}
    )
    placed = positions(keyed, [], ["_f", "_n", "_m", by], "rank").drop("_f", "_n", "_m")
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int"))


def top_runs(runs: DataFrame, n: int, finished="finished", state="state", metric="metric", run="run", higher=True) -> DataFrame:
    """The best ``n`` finished runs; runs without the metric come last."""
    m = F.col(metric)
    order = m.desc_nulls_last() if higher else m.asc_nulls_last()
    return runs.where(F.col(state) == finished).orderBy(order, F.col(run)).limit(n)


@F.pandas_udf(DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """Normal survival function; one row per candidate."""
    return z.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(v / math.sqrt(2.0)))


EXACT_SIDE = 8  # fixed value: up to this size of the smaller sample, without ties, the exact distribution is used


@functools.lru_cache(maxsize=EXACT_SIDE)
def _series(k: int) -> tuple[int, list[int], dict[int, dict[int, int]]]:
    """For a smaller sample of ``k``: a period, the numerator over ``(1 - q**period)**(k + 1)``, and the signed sums of
    subsets of 1 .. k by the size of the subset."""
    period = math.lcm(*range(1, k + 1))
    top = [1]
    # (1 - q**period) / (1 - q**i), for the parts and once more for the running sum
    for i in (1, *range(1, k + 1)):
        wide = [0] * (len(top) + period - i)
        for shift in range(0, period, i):
            for u, w in enumerate(top):
                wide[u + shift] += w
        top = wide
    subsets: dict[int, dict[int, int]] = {0: {0: 1}}
    for i in range(1, k + 1):
        for size in sorted(subsets, reverse=True):
            for total, w in subsets[size].items():
                more = subsets.setdefault(size + 1, {})
                more[total + i] = more.get(total + i, 0) - w
    return period, top, subsets


def u_at_least(u: int, n1: int, n2: int) -> float:
    """P(U >= u) when all orders are equally likely, in whole numbers, at a cost that the sizes don't change.

    The counts are the coefficients of a product of (1 - q**(n + i)) / (1 - q**i). Its numerator has few terms; the
    coefficients of the rest are binomials along each remainder of the period.
    """
    k, n = sorted((n1, n2))
    period, top, subsets = _series(k)
    ways = 0
    # as U is symmetric, the values from u up are as many as those up to here
    for size, sums in subsets.items():
        for total, sign in sums.items():
            rest = n1 * n2 - u - n * size - total
            if rest >= 0:
                ways += sign * sum(
                    top[j] * math.comb((rest - j) // period + k, k) for j in range(rest % period, min(rest + 1, len(top)), period)
                )
    return ways / math.comb(n + k, k)


def u_tail(n1: int, n2: int) -> tuple[float, ...]:
    """P(U >= u) for u = 0 .. n1 * n2."""
    return tuple(u_at_least(u, n1, n2) for u in range(n1 * n2 + 1))


@F.pandas_udf(DoubleType())
def exact_tail(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact one-sided p; one row per candidate."""
    return pd.Series([u_at_least(math.ceil(x), int(a), int(b)) for x, a, b in zip(u, n1, n2, strict=True)], dtype=float)


def rank_test(
    candidates: DataFrame, baseline: DataFrame, by="candidate", value="reward", alpha: float = ALPHA, blocks: int | None = None
) -> DataFrame:
    """One-sided Mann-Whitney U ("greater") of every candidate against one baseline.

    All samples are reduced to value counts and sorted once by value. The running
    baseline count at a candidate's value gives how many baseline scores it beats
    and ties, so the baseline is neither copied per candidate nor ranked again. Small
    samples without ties get the exact p, all others the normal one with tie correction.
    """
    base = baseline.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("nb"))
    cand = candidates.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("c"), F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("nc")
    )
    rows = base.select("v", F.lit(0).alias("tag"), F.lit(None).cast(cand.schema["c"].dataType).alias("c"), "nb", F.lit(None).cast("long").alias("nc"))
    rows = rows.unionByName(cand.withColumn("tag", F.lit(1)), allowMissingColumns=True)
    order = ["v", "tag", "c"]
    b = blocked(rows, [], order, blocks, "ranks")
    # two numbers describe the baseline: its size and its own tie term
    n_base, base_ties = b.agg(
        F.coalesce(F.sum("nb"), F.lit(0)), F.coalesce(F.sum(F.pow(F.col("nb").cast("double"), F.lit(3.0)) - F.col("nb")), F.lit(0.0))
    ).first()
    if not n_base:
        raise ValueError("baseline holds no scores")
    seen = scan(
        b, [], order,
        Running("leq", "sum", F.col("nb")),
        Running("last_base", "last", F.when(F.col("tag") == 0, F.struct("v", "nb"))),
    ).where("tag = 1")
    eq = F.when(F.col("last_base.v") == F.col("v"), F.col("last_base.nb")).otherwise(0)
    seen = seen.select("c", "nc", eq.alias("eq"), (F.coalesce("leq", F.lit(0)) - eq).alias("less"))
    t, e = (F.col("nc") + F.col("eq")).cast("double"), F.col("eq").cast("double")
    three = F.lit(3.0)
    sums = seen.groupBy(F.col("c").alias(by)).agg(
        F.sum("nc").alias("n"),
        F.sum(F.col("nc") * (F.col("less") + F.col("eq") / 2.0)).alias("u"),
        F.sum((F.pow(t, three) - t) - (F.pow(e, three) - e)).alias("_ties"),
    )
    n1, n2 = F.col("n").cast("double"), F.lit(float(n_base))
    both = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12.0 * ((both + 1) - (F.col("_ties") + F.lit(float(base_ties))) / (both * (both - 1))))
    out = sums.withColumn("z", F.try_divide(F.col("u") - n1 * n2 / 2.0 - 0.5, sigma))
    small = (F.least(n1, n2) <= EXACT_SIDE) & (F.col("_ties") + F.lit(float(base_ties)) == 0)
    # the branch not taken gets harmless sizes, as both are evaluated
    sizes = [F.when(small, x).otherwise(F.lit(1.0)) for x in (n1, n2)]
    exact = exact_tail(F.when(small, F.col("u")).otherwise(F.lit(0.0)), *sizes)
    out = out.withColumn("p_value", F.when(small, exact).otherwise(upper_tail("z"))).drop("_ties")
    return out.withColumns({"n_baseline": F.lit(int(n_base)), "passed": F.coalesce(F.col("p_value") < alpha, F.lit(False))})


def gate_verdict(tests: DataFrame, min_candidates: int = MIN_CANDIDATES) -> DataFrame:
    """All candidates must pass; few candidates are flagged as low power."""
    return tests.agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"),
        (F.count(F.lit(1)) < min_candidates).alias("low_power"),
    )


def score_parity(a: DataFrame, b: DataFrame, on="obs_id", scores="scores") -> DataFrame:
    """Row-wise comparison of two score tables: largest and mean difference, same choice."""
    l, r = a.select(on, F.col(scores).alias("_a")), b.select(on, F.col(scores).alias("_b"))
    both = l.join(r, on, "full")
    diff = abs_differences(F.col("_a"), F.col("_b"))
    whole = F.coalesce(F.size("_a") == F.size("_b"), F.lit(False))
    return both.select(
        on,
        whole.alias("comparable"),
        F.when(whole, F.array_max(diff)).alias("max_diff"),
        F.when(whole, array_sum(diff)).alias("sum_diff"),
        F.when(whole, F.size("_a")).alias("width"),
        F.coalesce(argmax(F.col("_a")) == argmax(F.col("_b")), F.lit(False)).alias("same_choice"),
    )


def parity_verdict(rows: DataFrame, tol: float = PARITY_TOLERANCE) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.max("max_diff").alias("max_diff"),
        (F.sum("sum_diff") / F.sum("width")).alias("mean_diff"),
        F.bool_and(F.col("same_choice") & F.col("comparable")).alias("action_match"),
    ).withColumn("passed", (F.col("max_diff") < tol) & F.col("action_match"))


