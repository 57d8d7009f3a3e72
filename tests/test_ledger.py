import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.functions import arrays, config, rewards
from tickweave.operators import ledger
from tickweave.operators.scan import blocked

KEYS, ORDER = ["user"], ["seq"]


@pytest.fixture(scope="module")
def log():
    rng = np.random.default_rng(6)
    n = 400
    pnl = np.where(rng.random(n) < 0.15, 0.0, rng.normal(0, 0.01, n))
    return pd.DataFrame({"user": np.where(rng.random(n) < 0.75, 1, 2), "seq": np.arange(n), "pnl": pnl})


def per_user(p, fn):
    return pd.concat([pd.DataFrame({"seq": g.seq, "v": fn(g)}) for _, g in p.groupby("user")]).sort_values("seq").v.to_numpy()


@pytest.mark.parametrize("blocks", [1, 11])
def test_nav_drawdown_and_streak(spark, log, blocks):
    b = blocked(spark.createDataFrame(log), KEYS, ORDER, blocks)
    out = ledger.with_account(b, KEYS, ORDER, F.col("pnl"), weight=0.5)
    got = out.toPandas().sort_values("seq")
    nav = per_user(log, lambda g: (1 + g.pnl * 0.5).cumprod())
    peak = per_user(log, lambda g: (1 + g.pnl * 0.5).cumprod().cummax().clip(lower=1.0))
    assert np.allclose(got.nav, nav) and np.allclose(got.peak_nav, peak)
    assert np.allclose(got.drawdown, (peak - nav) / peak)

    def streak(g):
        n, out = 0, []
        for x in g.pnl:
            n = n + 1 if x < 0 else (0 if x > 0 else n)
            out.append(n)
        return out

    assert (got.streak.to_numpy() == per_user(log, streak)).all()


def test_a_first_loss_is_a_drawdown_and_total_loss_stops(spark):
    df = spark.createDataFrame([(1, 1, -0.1), (1, 2, 0.05)], "user int, seq int, pnl double")
    b = blocked(df, KEYS, ORDER)
    assert ledger.with_account(b, KEYS, ORDER, F.col("pnl")).orderBy("seq").first().drawdown == pytest.approx(0.1)
    with pytest.raises(Exception, match="compounded"):
        ledger.with_account(b, KEYS, ORDER, F.lit(-1.5)).collect()


@pytest.mark.parametrize("blocks", [1, 11])
def test_breach_runs_and_new_best(spark, log, blocks):
    p = log.assign(v=np.where(log.seq % 17 == 0, np.nan, log.pnl))
    b = blocked(spark.createDataFrame(p), KEYS, ORDER, blocks)
    out = ledger.with_breach_runs(b, KEYS, ORDER, F.col("v"), hi=0.0, lo=-0.001, k=3)
    out = ledger.with_new_best(out, KEYS, ORDER, F.col("v")).toPandas().sort_values("seq")

    def breach(g):
        v = g.v.to_numpy()
        return [i >= 2 and (all(x > 0 for x in v[i - 2:i + 1]) or all(x < -0.001 for x in v[i - 2:i + 1])) for i in range(len(v))]

    def best(g):
        top, out = -np.inf, []
        for x in g.v:
            out.append(bool(x > top))
            top = max(top, x) if x == x else top
        return out

    assert (out.breach.to_numpy() == per_user(p, breach)).all()
    assert (out.new_best.to_numpy() == per_user(p, best)).all()


@pytest.mark.parametrize("blocks", [1, 7])
def test_position_state(spark, blocks):
    df = spark.createDataFrame([(1, i, u) for i, u in enumerate([-0.01, 0.03, 0.02, 0.05, 0.0])], "user int, seq int, u double")
    b = blocked(df, KEYS, ORDER, blocks)
    out = ledger.with_position_state(b, KEYS, ORDER, F.col("u"), F.lit(0.001), F.lit(-1)).orderBy("seq").collect()
    assert [r.hold_ticks for r in out] == [1, 2, 3, 4, 5]
    assert out[-1].cum_funding == pytest.approx(-0.005)
    assert [round(r.peak_unrealised, 6) for r in out] == [0.0, 0.032, 0.032, 0.054, 0.054]
    assert out[-1].give_back == pytest.approx(0.054 - 0.005)


BASE = dict(pnl=0.0, unrealised=0.0, has_position=False, drawdown=0.0, streak=0, opened=False, funding=0.0, cancels=0, peak=0.0)


@pytest.mark.parametrize(
    "change, term, want",
    [
        ({"pnl": 0.1}, "realised", 0.4),
        ({"pnl": -0.1}, "realised", -0.18),
        ({"unrealised": 0.1, "has_position": True}, "open_value", 0.03),
        ({"unrealised": 0.1}, "open_value", 0.0),
        ({"drawdown": 0.13}, "drawdown", -0.5),
        ({"drawdown": 0.03}, "drawdown", 0.0),
        ({"streak": 5, "opened": True}, "streak", -0.15),
        ({"streak": 5}, "streak", 0.0),
        ({"streak": 2, "opened": True}, "streak", 0.0),
        ({"funding": -0.2, "has_position": True}, "funding", -0.002),
        ({"funding": -0.2}, "funding", 0.0),
        ({"opened": True}, "entry", -0.02),
        ({"cancels": 3}, "churn", -0.015),
        ({"cancels": -1}, "churn", 0.0),
        ({"peak": 0.105, "has_position": True}, "give_back", -0.05),
        ({"peak": 0.005, "has_position": True}, "give_back", 0.0),
    ],
)
def test_one_reward_term(spark, change, term, want):
    out = rewards.with_rewards(spark.range(1), **{k: F.lit(v) for k, v in (BASE | change).items()}).first()
    assert out[term] == pytest.approx(want)
    rest = [t for t in rewards.TERMS if t not in (term, "entry")]
    if "unrealised" not in change:
        assert all(out[t] == 0 for t in rest)


def test_floor_comes_last_and_attribution_adds_up(spark):
    df = rewards.with_rewards(spark.range(2), **{k: F.lit(v) for k, v in (BASE | {"pnl": -9.0, "opened": True}).items()})
    assert df.first().reward == -5.0
    a = {r.term: r.total for r in rewards.attribution(df, []).collect()}
    assert a["realised"] == pytest.approx(-32.4) and a["entry"] == pytest.approx(-0.04)


def test_entropy_softmax_argmax(spark):
    rows = [([0.2] * 5,), ([1.0, 0.0, 0.0, 0.0, 0.0],), ([2.0, 2.0, 2.0, 2.0, 2.0],)]
    df = spark.createDataFrame(rows, "p array<double>")
    e = [r[0] for r in df.select(arrays.normalised_entropy(F.col("p"), 5)).collect()]
    assert e[0] == pytest.approx(1.0) and e[1] == pytest.approx(0.0, abs=1e-9) and e[2] == pytest.approx(1.0)
    x = [0.3, -2.0, 5.0, 5.0]
    df = spark.createDataFrame([(x,)], "p array<double>")
    s = df.select(arrays.softmax(F.col("p")).alias("s"), arrays.argmax(F.col("p")).alias("a")).first()
    assert np.allclose(s.s, np.exp(x) / np.exp(x).sum()) and s.a == 2


def test_settings(spark):
    def m(**kv):
        return F.create_map(*[F.lit(y) for k, v in kv.items() for y in (k.replace("__", "."), v)])
    out = lambda b, o: spark.range(1).select(config.merge_settings(b, o).alias("m")).first().m
    base = m(a__b="1", a__c="2", d="3", ab="4")
    assert out(base, m(a__b="9")) == {"a.b": "9", "a.c": "2", "d": "3", "ab": "4"}
    assert out(base, m(a="5")) == {"a": "5", "d": "3", "ab": "4"}
    assert out(base, m(d__e="6")) == {"a.b": "1", "a.c": "2", "ab": "4", "d.e": "6"}
    assert spark.range(1).select(config.set_key(base, "x.y", F.lit("7")).alias("m")).first().m["x.y"] == "7"
    j = spark.range(1).select(config.json_path(F.lit('{"a": {"b": 5}}'), "a.b")).first()[0]
    assert j == "5"
