import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.operators import gates


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(9)
    out = []
    for c, shift, n in (("base", 0.0, 150), ("good", 1.0, 120), ("same", 0.0, 80), ("tied", 0.5, 60)):
        x = rng.normal(shift, 1, n)
        # rounding makes ties within and across samples
        out.append(pd.DataFrame({"candidate": c, "reward": x.round(1), "length": rng.choice([9000, 5000], n, p=[0.95, 0.05])}))
    p = pd.concat(out, ignore_index=True)
    return p.assign(episode=np.arange(len(p)))


@pytest.mark.parametrize("blocks", [1, 6])
def test_summary_matches_numpy(spark, scores, blocks):
    got = gates.score_summary(spark.createDataFrame(scores), blocks=blocks).toPandas().set_index("candidate")
    for c, g in scores.groupby("candidate"):
        x, r = g.reward.to_numpy(), got.loc[c]
        assert r.n_episodes == len(x)
        for name, want in (
            ("mean_reward", x.mean()), ("std_reward", x.std()), ("median_reward", np.median(x)), ("p5_reward", np.percentile(x, 5)),
            ("p95_reward", np.percentile(x, 95)), ("min_reward", x.min()), ("max_reward", x.max()),
            ("ep_survival", (g.length >= 9000).mean()), ("mean_length", g.length.mean()), ("median_length", np.median(g.length)),
        ):
            assert r[name] == pytest.approx(want, abs=1e-12), name


def test_a_single_score(spark):
    one = spark.createDataFrame([("a", 3.5, 9000, 1)], "candidate string, reward double, length long, episode long")
    r = gates.score_summary(one).first()
    assert (r.p5_reward, r.median_reward, r.p95_reward, r.std_reward) == (3.5, 3.5, 3.5, 0.0)


def u_by_pairs(a, b):
    return sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)


@pytest.mark.parametrize("blocks", [1, 8])
def test_rank_test_matches_pairwise_counts(spark, scores, blocks):
    df = spark.createDataFrame(scores)
    got = gates.rank_test(df.where("candidate <> 'base'"), df.where("candidate = 'base'"), blocks=blocks).toPandas().set_index("candidate")
    b = scores[scores.candidate == "base"].reward.to_numpy()
    for c in ("good", "same", "tied"):
        a = scores[scores.candidate == c].reward.to_numpy()
        n1, n2 = len(a), len(b)
        t = pd.Series(np.concatenate([a, b])).value_counts().to_numpy().astype(float)
        n = n1 + n2
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
        u = u_by_pairs(a, b)
        z = (u - n1 * n2 / 2 - 0.5) / sd
        assert got.loc[c].u == u and got.loc[c].z == pytest.approx(z)
        assert got.loc[c].p_value == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))
    assert got.loc["good"].passed and not got.loc["same"].passed
    v = gates.gate_verdict(spark.createDataFrame(got.reset_index())).first()
    assert (v.n_candidates, v.all_passed, v.low_power) == (3, False, False)


def test_hand_computed_u(spark):
    a = spark.createDataFrame([("c", x) for x in (1.0, 2.0, 2.0, 5.0)], "candidate string, reward double")
    b = spark.createDataFrame([("b", x) for x in (2.0, 3.0, 0.0)], "candidate string, reward double")
    # 1 beats 0; each 2 beats 0 and ties 2; 5 beats all
    assert gates.rank_test(a, b).first().u == 1 + 1.5 + 1.5 + 3
    with pytest.raises(ValueError):
        gates.rank_test(a, b.where("false"))


def test_rubric_is_strict_and_ranks_passers_first(spark):
    rows = [("edge", 2.0, 1.0, 0.95, 0.0), ("pass", 2.1, 0.1, 0.91, -14.9), ("high", 9.0, 1.0, 0.5, 0.0), ("failed", None, None, None, None)]
    s = spark.createDataFrame(rows, "candidate string, mean_reward double, median_reward double, ep_survival double, p5_reward double")
    out = gates.rank_candidates(gates.rubric(s)).orderBy("rank").collect()
    assert [r.candidate for r in out] == ["pass", "high", "edge", "failed"]
    assert [r.passes_rubric for r in out] == [True, False, False, False]
    assert {m.metric: m["pass"] for m in out[1].rubric_breakdown} == {"mean_reward": True, "median_reward": True, "ep_survival": False, "p5_reward": True}


def test_top_runs(spark):
    df = spark.createDataFrame([(1, "finished", 5.0), (2, "crashed", 9.0), (3, "finished", None), (4, "finished", 7.0)], "run int, state string, metric double")
    assert [r.run for r in gates.top_runs(df, 3).collect()] == [4, 1, 3]
    assert [r.run for r in gates.top_runs(df, 3, higher=False).collect()] == [1, 4, 3]


def test_parity(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 0.0])], "obs_id int, scores array<double>")
    near = spark.createDataFrame([(1, [1.0, 2.00005]), (2, [5.0, 0.0])], "obs_id int, scores array<double>")
    v = gates.parity_verdict(gates.score_parity(a, near)).first()
    assert v.passed and v.max_diff == pytest.approx(5e-5) and v.mean_diff == pytest.approx(5e-5 / 4)
    flip = a.withColumn("scores", F.reverse("scores"))
    assert not gates.parity_verdict(gates.score_parity(a, flip)).first().passed
    short = a.where("obs_id = 1")
    assert not gates.parity_verdict(gates.score_parity(a, short)).first().action_match


def test_small_samples_get_the_exact_p(spark):
    import itertools

    a, b = [1.5, 4.5, 6.5], [1.0, 2.0, 3.0, 4.0, 5.0]
    u = sum(x > y for x in a for y in b)
    values = a + b
    every = [sum(values[i] > values[j] for i in c for j in range(8) if j not in c) for c in itertools.combinations(range(8), 3)]
    df = spark.createDataFrame([("x", v) for v in a] + [("t", v) for v in (1.0, 2.0, 9.0)], "candidate string, reward double")
    base = spark.createDataFrame([("base", v) for v in b], "candidate string, reward double")
    got = {r.candidate: r for r in gates.rank_test(df, base).collect()}
    assert got["x"].u == u and got["x"].p_value == pytest.approx(sum(v >= u for v in every) / len(every))
    # with ties the normal form stays
    assert got["t"].p_value == pytest.approx(0.5 * math.erfc(got["t"].z / math.sqrt(2)))
    assert gates.u_tail(2, 2) == pytest.approx((1.0, 5 / 6, 4 / 6, 2 / 6, 1 / 6))


def plain_tail(n1, n2):
    """P(U >= u) from counts, term by term."""
    k, n = sorted((n1, n2))
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, k + 1):
        for u in range(n1 * n2, n + i - 1, -1):
            ways[u] -= ways[u - n - i]
        for u in range(i, n1 * n2 + 1):
            ways[u] += ways[u - i]
    return [sum(ways[u:]) / sum(ways) for u in range(n1 * n2 + 1)]


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (1, 9), (3, 5), (6, 4), (8, 8), (40, 7), (8, 61)])
def test_closed_form_equals_the_counts(n1, n2):
    assert list(gates.u_tail(n1, n2)) == plain_tail(n1, n2)


def test_exact_p_at_any_size_of_the_baseline():
    assert gates.u_at_least(1_000_001, 1, 1_000_001) == 1 / 1_000_002
    assert gates.u_at_least(1_200_000, 3, 400_000) == pytest.approx(6 / (400_001 * 400_002 * 400_003))
    assert gates.u_at_least(8 * 125_001, 8, 125_001) == pytest.approx(1 / math.comb(125_009, 8))
    assert gates.u_at_least(0, 8, 10**9) == 1.0
    # with one score against n, U is uniform; the middle of two against n is even
    assert gates.u_at_least(500_001, 1, 10**6) == 500_000 / 1_000_001
    assert gates.u_at_least(10**6, 2, 10**6) == pytest.approx(0.5, abs=1e-6)


def test_a_single_best_score_passes_above_a_million_pairs(spark):
    base = spark.range(1_000_001).select(F.lit("base").alias("candidate"), F.col("id").cast("double").alias("reward"))
    top = spark.createDataFrame([("top", 2e6), ("middle", 500_000.5)], "candidate string, reward double")
    got = {r.candidate: r for r in gates.rank_test(top, base).collect()}
    assert got["top"].p_value == pytest.approx(1 / 1_000_002) and got["top"].passed
    assert got["middle"].p_value == pytest.approx(500_001 / 1_000_002) and not got["middle"].passed
