import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.operators import splits, stats


def slab(spark, n=1003, hot=0.7):
    rng = np.random.default_rng(0)
    sym = np.where(rng.random(n) < hot, "HOT", "B")
    p = pd.DataFrame({"symbol": sym, "ts_ms": np.arange(n) // 2, "seq": np.arange(n), "x": rng.normal(size=n)})
    return spark.createDataFrame(p), p


@pytest.mark.parametrize("blocks", [1, 7])
def test_ratio_split_is_by_row_count_and_leak_free(spark, blocks):
    df, p = slab(spark)
    out = splits.chrono_split(df, 0.77, blocks=blocks)
    got = {(r.symbol, r.split): r.n_rows for r in splits.split_bounds(out).collect()}
    for s, n in p.symbol.value_counts().items():
        assert got[(s, "train")] == int(n * 0.77)
        assert got[(s, "eval")] == n - int(n * 0.77)
    o = out.toPandas()
    for _, g in o.groupby("symbol"):
        assert g[g.split == "train"].seq.max() < g[g.split == "eval"].seq.min()


def test_ratio_bounds(spark):
    df, _ = slab(spark, 10)
    for bad in (0.4, 1.0):
        with pytest.raises(ValueError):
            splits.chrono_split(df, bad)


def test_holdout(spark):
    df, p = slab(spark)
    out = splits.holdout_split(df, days=0.5, rows_per_day=201, blocks=4).toPandas()
    # round half to even: 100.5 becomes 100
    assert out[out.split == "holdout"].groupby("symbol").size().tolist() == [100, 100]
    with pytest.raises(Exception, match="holdout"):
        splits.holdout_split(df, days=10, rows_per_day=100).collect()


def test_tail(spark):
    df, p = slab(spark)
    got = splits.tail_rows(df, 5, blocks=3).toPandas()
    for s, g in p.groupby("symbol"):
        assert sorted(got[got.symbol == s].seq) == g.seq.tail(5).tolist()


def test_walk_forward(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    df = spark.createDataFrame([("X", d, i) for i, d in enumerate(days)], "symbol string, day date, v int")
    out = splits.walk_forward_split(df, "2024-01-02", "2024-01-10", "2024-01-11", "2024-01-12")
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 9, "eval": 2}
    with pytest.raises(ValueError):
        splits.walk_forward_split(df, "2024-01-02", "2024-01-10", "2024-01-10", "2024-01-12")
    folds = splits.make_folds("2024-01-01", "2024-01-30", 10, 5, 5)
    assert folds[0] == ("2024-01-01", "2024-01-10", "2024-01-11", "2024-01-15") and len(folds) == 4
    n = {(r.fold, r.split): r["count"] for r in splits.walk_forward_folds(df, folds).groupBy("fold", "split").count().collect()}
    assert n == {(i, s): k for i in range(4) for s, k in (("train", 10), ("eval", 5))}
    late = splits.make_folds("2024-01-20", "2024-02-20", 10, 5, 5)
    with pytest.raises(ValueError):
        splits.require_every_fold(splits.walk_forward_folds(df, late).groupBy("fold", "split").count(), len(late))


def test_window_sample(spark):
    df, p = slab(spark)
    a = splits.sample_windows(df, 30, 20, seed=1, blocks=3).toPandas()
    b = splits.sample_windows(df, 30, 20, seed=1, blocks=8).toPandas()
    assert len(a) == 600
    cols = ["sample_id", "symbol", "pos", "seq"]
    pd.testing.assert_frame_equal(a.sort_values(cols)[cols].reset_index(drop=True), b.sort_values(cols)[cols].reset_index(drop=True))
    sizes = p.symbol.value_counts()
    for _, g in a.groupby("sample_id"):
        assert g.pos.max() - g.pos.min() == 19 and g.symbol.nunique() == 1
        assert 0 <= g.start.iloc[0] < sizes[g.symbol.iloc[0]] - 21
    c = splits.sample_windows(df, 30, 20, seed=2).toPandas()
    assert sorted(c.seq) != sorted(a.seq)


def test_dedupe_keeps_the_first_by_sequence(spark):
    a = spark.createDataFrame([("X", 1, 5, "five"), ("X", 2, 6, "six")], "symbol string, ts_ms long, seq long, v string")
    b = spark.createDataFrame([("X", 1, 3, "three"), ("X", 3, 9, None)], "symbol string, ts_ms long, seq long, v string")
    assert sorted((r.ts_ms, r.seq, r.v) for r in splits.concat_dedupe([a, b]).collect()) == [(1, 3, "three"), (2, 6, "six"), (3, 9, None)]


def test_order_violation(spark):
    df = spark.createDataFrame([("X", "train", 10), ("X", "eval", 10), ("Y", "train", 10), ("Y", "eval", 11)], "symbol string, split string, ts_ms long")
    assert [r.symbol for r in splits.order_violations(splits.split_bounds(df)).collect()] == ["X"]


def test_statistics_match_numpy_and_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"symbol": "X", "a": rng.normal(0, 1e-6, 2000), "b": rng.normal(5e5, 1e6, 2000), "c": 7.0, "d": np.where(np.arange(2000) == 3, np.nan, 1.5)})
    for n in (1, 16):
        got = {r.feature: r for r in stats.norm_stats(spark.createDataFrame(p).repartition(n), ["a", "b", "c", "d"]).collect()}
        for f in "ab":
            assert got[f].mean == pytest.approx(p[f].mean(), rel=1e-9) and got[f].n == 2000
        assert got["b"].std == pytest.approx(p.b.std(ddof=0), rel=1e-9)
        assert got["c"].std == 1.0 and got["c"].mean == 7.0
        assert (got["d"].mean, got["d"].std) == (0.0, 1.0)
    skip = {r.feature: r for r in stats.norm_stats(spark.createDataFrame(p), ["d"], nan_policy="skip").collect()}
    assert skip["d"].mean == 1.5


def test_zscore_clip_and_unknown_symbol(spark):
    df = spark.createDataFrame([("X", 1.0), ("X", 3.0), ("X", None)], "symbol string, a double")
    s = stats.norm_stats(df.dropna(), ["a"])
    out = [r.a for r in stats.apply_stats(df, s, ["a"], clip=0.5).orderBy("a").collect()]
    assert out == [None, -0.5, 0.5]
    assert [r.a for r in stats.apply_stats(df.dropna(), s, ["a"], clip=0).orderBy("a").collect()] == [-1.0, 1.0]
    with pytest.raises(schemas.ContractError, match="Z"):
        stats.apply_stats(df.withColumn("symbol", F.lit("Z")), s, ["a"])


def test_train_only_statistics(spark):
    df = spark.createDataFrame([("X", "train", 1.0), ("X", "train", 3.0), ("X", "eval", 1e9), ("X", "eval", float("inf"))], "symbol string, split string, a double")
    out = stats.normalised_features(df, ["a"], clip=10.0, dtype="double").orderBy("split", "a").collect()
    assert [r.a for r in out] == [-2.0, 10.0, -1.0, 1.0]


def test_bundle_checks(spark):
    train = spark.createDataFrame([("X", 1.0, 2.0), ("X", 3.0, 2.0), ("Y", 5.0, 9.0)], "symbol string, a double, b double")
    long = stats.norm_stats(train, ["a", "b"])
    rec = stats.symbol_records(long, ["a", "b"], 10.0)
    b = stats.bundle([rec.where("symbol = 'X'"), rec.where("symbol = 'Y'")], ["a", "b"])
    assert b.first().by_symbol["X"].mean == [2.0, 2.0] and b.first().clip == 10.0
    key = lambda r: (r.symbol, r.feature)
    assert sorted(map(tuple, stats.unbundle(b, ["a", "b"]).collect())) == sorted(map(tuple, long.select("symbol", "feature", "mean", "std", "n").collect()))
    for change in (
        {"feature_version": F.lit("9")}, {"feature_spec_checksum": F.lit("x")}, {"mean": F.array(F.lit(1.0))}, {"clip": F.lit(3.0)},
    ):
        other = rec.where("symbol = 'Y'").withColumns(change)
        with pytest.raises(schemas.ContractError):
            stats.bundle([rec.where("symbol = 'X'"), other], ["a", "b"])
    assert stats.bundle([rec.where("symbol = 'X'"), rec.where("symbol = 'Y'").withColumn("clip", F.lit(3.0))], ["a", "b"], clip=4.0).first().clip == 4.0
    with pytest.raises(schemas.ContractError):
        stats.bundle([rec.where("false")], ["a", "b"])


def test_sanitised(spark):
    s = spark.createDataFrame([("X", "a", float("nan"), 1e-12), ("X", "b", 2.0, float("inf")), ("X", "c", None, 3.0)], "symbol string, feature string, mean double, std double")
    assert {r.feature: (r.mean, r.std) for r in stats.sanitised(s).collect()} == {"a": (0.0, 1.0), "b": (2.0, 1.0), "c": (0.0, 3.0)}


def test_manifest_and_fingerprint(spark):
    df, p = slab(spark)
    out = splits.chrono_split(df, 0.8)
    m = {r.symbol: r for r in stats.manifest(out, 0.8, ["x"]).collect()}
    n = p.symbol.value_counts()
    assert m["HOT"].train_rows == int(n["HOT"] * 0.8) and m["HOT"].train_rows + m["HOT"].eval_rows == n["HOT"]
    a = stats.fingerprint(df, ["x", "seq"]).first()
    assert a == stats.fingerprint(df.repartition(5).orderBy(F.rand()), ["x", "seq"]).first()
    assert a.fingerprint != stats.fingerprint(df.withColumn("x", F.when(F.col("seq") == 4, 0.0).otherwise(F.col("x"))), ["x", "seq"]).first().fingerprint


@pytest.mark.parametrize("blocks", [1, 5])
def test_non_increasing(spark, blocks):
    rows = [("X", 1, i, 10 * i) for i in range(20)] + [("Y", 1, i, 10 * i) for i in range(20)]
    rows[25] = ("Y", 1, 5, 40)  # repeats the one before
    df = spark.createDataFrame(rows, "symbol string, day int, seq int, ts_ms long")
    assert [tuple(r) for r in splits.non_increasing(df, blocks=blocks).collect()] == [("Y", 1)]


def test_version_contract(spark):
    df = spark.createDataFrame([(schemas.FEATURE_VERSION,)] * 3, "feature_version string")
    assert schemas.require_version(df) is df
    for bad in ("0.0.9", None):
        with pytest.raises(schemas.ContractError):
            schemas.require_version(df.union(spark.createDataFrame([(bad,)], "feature_version string")))


def test_parts_give_the_same_positions_as_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(k, dt.date(2024, 1, 1 + int(t) // 100), int(t), i, float(i)) for i, (k, t) in enumerate(zip(rng.choice(list("aab"), 400), rng.integers(0, 1000, 400)))]
    df = spark.createDataFrame(rows, "symbol string, day date, ts_ms long, seq long, x double")

    def run(fn, *args, **kw):
        both = [fn(df, *args, part=p, **kw) for p in (None, "day")]
        cols = sorted(both[0].columns)
        return [sorted(map(tuple, b.select(cols).collect())) for b in both]

    for fn, args in ((splits.chrono_split, (0.7,)), (splits.holdout_split, (1.0, 60)), (splits.tail_rows, (37,)), (splits.sample_windows, (9, 12, 3))):
        one, two = run(fn, *args)
        assert one == two and one
    plan = splits.chrono_split(df, part="day")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
