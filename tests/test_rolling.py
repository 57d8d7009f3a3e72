import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.operators import features, rolling

N = 400
DAYS = ["2024-01-01", "2024-01-02"]


@pytest.fixture(scope="module")
def snaps():
    rng = np.random.default_rng(3)
    out = []
    for d in DAYS:
        base = int(pd.Timestamp(d).value // 1_000_000)
        signed = rng.integers(-5, 6, N).astype(float)
        price = 100 + rng.normal(0, 0.1, N).cumsum()
        price[200:320] = price[199]  # quiet after volatile
        price[50] = 0.0  # not a price
        out.append(pd.DataFrame({
            "symbol": "X", "day": pd.Timestamp(d).date(), "ts_ms": base + 100 * np.arange(N), "signed_volume": signed,
            "abs_volume": np.abs(signed), "micro_price": price, "funding_rate": np.where(np.arange(N) < 10, np.nan, 0.001),
        }))
    return pd.concat(out, ignore_index=True)


def load(spark, p):
    return schemas.nan_to_null(spark.createDataFrame(p))


def back(df, *cols):
    return df.select("day", "ts_ms", *cols).toPandas().sort_values("ts_ms").reset_index(drop=True)


def by_day(p, fn):
    return p.groupby("day", group_keys=False)[p.columns.tolist()].apply(fn).sort_index()


def test_flow_windows_match_brute_force(spark, snaps):
    got = back(rolling.flow_features(load(spark, snaps), {"a": 5, "b": 50}), "ofi_a", "ofi_b", "trade_flow_imb_a", "trade_flow_imb_b")
    for k, n in (("a", 5), ("b", 50)):
        s = by_day(snaps, lambda g: g.signed_volume.rolling(n, min_periods=n).sum())
        a = by_day(snaps, lambda g: g.abs_volume.rolling(n, min_periods=n).sum())
        pd.testing.assert_series_equal(got[f"ofi_{k}"], s, check_names=False)
        imb = (s / a.where(a > 0)).fillna(0.0).where(a.notna())
        pd.testing.assert_series_equal(got[f"trade_flow_imb_{k}"], imb, check_names=False)
        assert got[f"ofi_{k}"].isna().sum() == (n - 1) * len(DAYS)
        assert got[f"trade_flow_imb_{k}"].abs().max() <= 1


def test_windows_with_missing_inputs_are_missing(spark):
    p = pd.DataFrame({"symbol": "X", "day": pd.Timestamp("2024-01-01").date(), "ts_ms": range(8), "v": [1.0, 2, np.nan, 4, 5, 6, np.nan, 8]})
    got = back(rolling.rolling_sums(load(spark, p), {"s": ("v", 3)}), "s").s
    assert got.fillna(-1).tolist() == [-1, -1, -1, -1, -1, 15.0, -1, -1]


def test_return_and_volatility(spark, snaps):
    out = rolling.realised_vol(rolling.log_return(load(spark, snaps), ticks=10), {"a": 5, "b": 100})
    got = back(out, "micro_price_log_ret", "realized_vol_a", "realized_vol_b")
    p = snaps.assign(p=snaps.micro_price.where(snaps.micro_price > 0))
    ret = by_day(p, lambda g: np.log(g.p / g.p.shift(10)))
    assert np.allclose(got.micro_price_log_ret, ret, equal_nan=True)
    for k, n in (("a", 5), ("b", 100)):
        rv = by_day(p, lambda g: np.sqrt(np.log(g.p / g.p.shift(1)).pow(2).rolling(n, min_periods=n).sum().clip(lower=0)))
        # the pandas rolling sum keeps rounding noise of its own in quiet windows
        assert np.allclose(got[f"realized_vol_{k}"], rv, equal_nan=True, atol=1e-7)
    quiet = got.iloc[210:320].realized_vol_a
    assert (quiet == 0.0).all()
    # the first return is missing, so the first valid row is n
    assert got.realized_vol_a[:5].isna().all() and not np.isnan(got.realized_vol_a[5])


def test_funding(spark, snaps):
    got = back(rolling.funding_features(load(spark, snaps), ticks=50), "funding_8h_rate", "funding_cumulative")
    want = by_day(snaps, lambda g: g.funding_rate.ffill().rolling(50, min_periods=1).sum())
    assert np.allclose(got.funding_cumulative, want, equal_nan=True)
    assert got.funding_8h_rate.isna().sum() == 10 * len(DAYS)


def test_no_value_depends_on_the_future(spark, snaps):
    cut = snaps.ts_ms.iloc[250]
    other = snaps.copy()
    other.loc[other.ts_ms > cut, ["micro_price", "signed_volume", "abs_volume", "funding_rate"]] = 77.0

    def run(p):
        f = rolling.flow_features(load(spark, p), {"a": 10})
        f = rolling.realised_vol(rolling.log_return(f), {"a": 10})
        f = rolling.funding_features(f)
        cols = ["ofi_a", "trade_flow_imb_a", "micro_price_log_ret", "realized_vol_a", "funding_cumulative"]
        r = back(f, *cols)
        return r[r.ts_ms <= cut][cols]

    pd.testing.assert_frame_equal(run(snaps), run(other))


def full_snaps(spark, n=4500, depth=True):
    rng = np.random.default_rng(5)
    base = int(pd.Timestamp("2024-03-05").value // 1_000_000)
    signed = rng.integers(-5, 6, n).astype(float)
    p = pd.DataFrame({
        "symbol": "X", "day": pd.Timestamp("2024-03-05").date(), "ts_ms": base + 100 * np.arange(n), "signed_volume": signed,
        "abs_volume": np.abs(signed), "micro_price": 100 * np.exp(rng.normal(0, 1e-5, n).cumsum()), "log_spread_bps": 1.0,
        "top1_size_imbalance": 0.1, "mid": 100.0, "bid_px": 99.0, "ask_px": 101.0,
    })
    if depth:
        for c in schemas.DEPTH_LEVELS.values():
            p[c] = 5.0
    return spark.createDataFrame(p)


def test_feature_table_contract(spark):
    f = features.build_features(full_snaps(spark))
    assert f.columns[3:29] == list(schemas.MARKET_FEATURES)
    assert {t for n, t in f.dtypes if n in schemas.MARKET_FEATURES} == {"float"}
    p = f.toPandas()
    # realised volatility over 3000 ticks needs 3001 rows
    assert len(p) == 4500 - 3000
    assert np.allclose(p.hour_of_day_sin**2 + p.hour_of_day_cos**2, 1, atol=1e-6)
    assert p.funding_8h_rate.isna().all() and (p.feature_version == schemas.FEATURE_VERSION).all()


def test_missing_depth_is_zero_and_other_missing_columns_raise(spark):
    f = features.build_features(full_snaps(spark, 3100, depth=False))
    assert f.agg(F.max("bid_depth_pct_neg_0_1")).first()[0] == 0.0
    with pytest.raises(schemas.ContractError):
        features.build_features(full_snaps(spark, 3100).drop("log_spread_bps"))
    with pytest.raises(schemas.ContractError):
        features.build_features(full_snaps(spark, 3100).drop("micro_price"))


def test_features_share_one_shuffle(spark):
    plan = features.build_features(full_snaps(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_checksum_changes_with_the_contract():
    a = schemas.contract_checksum()
    assert len(a) == 16 and a == schemas.contract_checksum()
    assert a != schemas.contract_checksum("0.2.0")
    assert a != schemas.contract_checksum(names=schemas.MARKET_FEATURES[::-1])
