"""Stored partial moments give the statistics of all rows, whatever the days and batches they come in."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import splits, stats

FEATURES = ["a", "b", "c"]
SCHEMA = "symbol string, day date, a double, b double, c double"


def rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 12)))
        b = None if i % 37 == 0 else float("nan") if i % 41 == 0 else float(rng.normal())
        # a large offset with a small spread
        out.append(("HOT" if rng.random() < 0.8 else "B", day, 1e9 + float(rng.normal()), b, 4.0))
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([*rows(), ("ONE", dt.date(2024, 1, 3), 5.0, None, float("inf"))], SCHEMA)


def close(got, want, keys):
    def table(x):
        return {tuple(r[k] for k in (*keys, "feature")): (r.mean, r.std, r.n) for r in x.collect()}
    a, b = table(got), table(want)
    assert a.keys() == b.keys()
    # beside an offset of 1e9 a double has seven digits left for the spread
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-7), k


@pytest.mark.parametrize("policy", ["neutral", "skip"])
def test_merged_days_equal_one_pass(df, policy):
    merged = stats.merge_moments(stats.day_moments(df, FEATURES))
    close(stats.moments_stats(merged, nan_policy=policy), stats.norm_stats(df, FEATURES, nan_policy=policy), ["symbol"])


def test_batches_of_a_day_are_added(spark, df):
    parts = [stats.day_moments(p, FEATURES) for p in df.randomSplit([0.2, 0.5, 0.3], 5)]
    parts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    close(stats.moments_stats(stats.merge_moments(parts)), stats.norm_stats(df, FEATURES), ["symbol"])


def test_spread_beside_a_large_offset(spark):
    x = [1e9 + k for k in (4.0, 7.0, 13.0, 16.0)]
    data = [("S", dt.date(2024, 1, 1 + i), v, v, v) for i, v in enumerate(x)]
    merged = stats.merge_moments(stats.day_moments(spark.createDataFrame(data, SCHEMA), FEATURES))
    assert {r.m2 for r in merged.collect()} == {90.0}


def test_folds_merge_days_and_read_no_rows(spark, df):
    folds = splits.make_folds("2024-01-01", "2024-01-12", train_days=4, eval_days=2, step_days=2)
    parts = stats.materialise(stats.day_moments(df, FEATURES), "t-moments")
    train = splits.walk_forward_folds(df, folds).where("split = 'train'")
    got = stats.fold_stats(parts, folds)
    close(got, stats.norm_stats(train, FEATURES, by=("fold", "symbol")), ["fold", "symbol"])
    assert got.select("fold").distinct().count() == len(folds)
    # the rows behind the moments are in no scan of the plan
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "t-moments" in str(got.inputFiles()) and plan.count("Relation") == 1


def test_empty_and_unknown_policy(spark, df):
    assert stats.merge_moments(stats.day_moments(df.limit(0), FEATURES)).count() == 0
    with pytest.raises(ValueError, match="nan_policy"):
        stats.moments_stats(stats.merge_moments(stats.day_moments(df.where(F.lit(True)), FEATURES)), nan_policy="x")
