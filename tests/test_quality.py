import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickweave.operators import quality as K

D0 = dt.date(2024, 1, 1)
Q = "symbol string, day date, ts_ms long, seq long, bid_px double, bid_sz double, ask_px double, ask_sz double"
S = "symbol string, day date, ts_ms long, seq long, bid_px double, ask_px double, mid double, log_spread_bps double"


def quotes(spark, n=60, **defects):
    rows = [["X", D0, 1000 + 50 * i, i, 10.0, 1.0, 11.0, 1.0] for i in range(n)]
    place = {"ts_ms": 2, "bid_px": 4, "bid_sz": 5, "ask_px": 6, "ask_sz": 7}
    for col, (i, v) in defects.items():
        rows[i][place[col]] = v
    return spark.createDataFrame([tuple(r) for r in rows], Q)


def snaps(spark, n=200, step=100, change=None):
    rows = [["X", D0, step * i, i, 10.0, 11.0, 10.5, 5.0] for i in range(n)]
    if change:
        change(rows)
    return spark.createDataFrame([tuple(r) for r in rows], S)


def found(df):
    return {(r.severity, r.check): (r.n, r.ts_ms) for r in df.collect()}


# seven rows per block puts defects on, before and after block borders
@pytest.mark.parametrize("block_rows", [7, 1 << 20])
@pytest.mark.parametrize(
    "defects, want",
    [
        ({}, {}),
        ({"bid_px": (14, 12.0)}, {("ERROR", "crossed_book"): (1, 1700)}),
        ({"ask_px": (20, None)}, {("ERROR", "nan"): (1, None)}),
        ({"ask_px": (20, float("nan"))}, {("ERROR", "nan"): (1, None)}),
        ({"bid_sz": (21, 0.0)}, {("ERROR", "nonpositive"): (1, None)}),
        ({"ts_ms": (14, 900)}, {("ERROR", "monotonic"): (1, None)}),
        ({"ts_ms": (28, 5)}, {("ERROR", "monotonic"): (1, None)}),
    ],
)
def test_one_defect_one_issue_in_quotes(spark, defects, want, block_rows):
    assert found(K.quote_issues(quotes(spark, **defects), block_rows=block_rows)) == want


def test_trades(spark):
    t = spark.createDataFrame(
        [("X", D0, 10, 1, 5.0, 1.0), ("X", D0, 5, 2, 5.0, 0.0), ("X", D0, 20, 3, -1.0, 1.0)],
        "symbol string, day date, ts_ms long, seq long, price double, quantity double",
    )
    assert found(K.trade_issues(t)) == {
        ("ERROR", "monotonic"): (1, None), ("ERROR", "nonpositive_qty"): (1, None), ("ERROR", "nonpositive_price"): (1, None),
    }


def test_depth(spark):
    d = spark.createDataFrame([("X", D0, -1.0, 1.0), ("X", D0, 1.0, None), ("X", D0, 1.0, 1.0)], "symbol string, day date, depth double, notional double")
    assert found(K.depth_issues(d)) == {("ERROR", "negative_depth"): (1, None)}


@pytest.mark.parametrize("block_rows", [7, 1 << 20])
def test_snapshot_gaps(spark, block_rows):
    assert found(K.snapshot_issues(snaps(spark), 100, block_rows=block_rows)) == {}

    def small(rows):
        for r in rows[70:]:
            r[2] += 500

    def large(rows):
        for r in rows[70:]:
            r[2] += 1500
        for r in rows[140:]:
            r[2] += 2000

    def repeated(rows):
        rows[70][2] = rows[69][2]

    got = found(K.snapshot_issues(snaps(spark, change=small), 100, block_rows=block_rows))
    assert got == {("WARNING", "snapshot_gap"): (1, None)}
    got = found(K.snapshot_issues(snaps(spark, change=large), 100, block_rows=block_rows))
    assert got == {("ERROR", "snapshot_gap"): (2, 7000 + 1500)}
    got = found(K.snapshot_issues(snaps(spark, change=repeated), 100, block_rows=block_rows))
    assert got == {("WARNING", "snapshot_gap"): (2, None)}


def test_wide_spread_needs_more_than_one_percent(spark):
    def wide(n):
        def change(rows):
            for r in rows[:n]:
                r[7] = 80.0
        return change

    assert found(K.snapshot_issues(snaps(spark, change=wide(2)), 100)) == {}
    assert found(K.snapshot_issues(snaps(spark, change=wide(3)), 100)) == {("WARNING", "wide_spread"): (3, None)}


def test_candle_drift(spark):
    h = K.HOUR_MS
    s = spark.createDataFrame([("X", D0, t, 100.0) for t in (0, h - 1, h + 5)], "symbol string, day date, ts_ms long, mid double")
    def kl(*rows):
        return spark.createDataFrame([("X", D0, o, c) for o, c in rows], "symbol string, day date, open_time long, close double")
    r = K.kline_drift(s, kl((0, 100.0), (h, 100.05))).first()
    assert (r.n_checked, r.n_bad, r.severity) == (2, 1, "ERROR")
    assert r.worst_bps == pytest.approx(0.05 / 100.05 * 1e4)
    assert K.kline_drift(s, kl((0, 100.0))).first().severity == "OK"
    # a candle that closes before the first snapshot, and one without a close
    r = K.kline_drift(s, kl((-2 * h, 100.0), (0, None))).first()
    assert (r.n_checked, r.severity) == (0, "WARNING")
    assert found(K.drift_issues(K.kline_drift(s, kl((-2 * h, 100.0))))) == {("WARNING", "kline_xref_empty"): (1, None)}


def test_a_silent_hour_is_filled_from_the_last_snapshot(spark):
    h = K.HOUR_MS
    s = spark.createDataFrame([("X", D0, 10, 100.0)], "symbol string, day date, ts_ms long, mid double")
    k = spark.createDataFrame([("X", D0, 3 * h, 100.0)], "symbol string, day date, open_time long, close double")
    assert K.kline_matches(s, k).first().mid == 100.0


def test_gate_and_outcomes(spark):
    good = quotes(spark)
    bad = quotes(spark, bid_px=(3, 50.0)).withColumn("symbol", F.lit("Y"))
    q = good.unionByName(bad)
    issues = K.quote_issues(q)
    kept, held = K.gate(q, issues)
    assert {r.symbol for r in kept.select("symbol").distinct().collect()} == {"X"}
    assert held.count() == 60
    out = K.outcomes(q, issues)
    assert {(r.symbol, r.status) for r in out.collect()} == {("X", "ok"), ("Y", "failed")}
    with pytest.raises(ValueError):
        K.require_all_ok(out)
    expected = spark.createDataFrame([("X", D0), ("Z", D0)], "symbol string, day date")
    assert found(K.empty_days(expected, q, "quotes", "ERROR")) == {("ERROR", "empty"): (1, None)}


def test_finite_and_length_guards(spark):
    df = spark.createDataFrame([("X", 1.0), ("X", float("inf"))], "symbol string, mid double")
    with pytest.raises(Exception, match="non-finite value in mid"):
        K.require_finite(df, ["mid"]).collect()
    assert K.require_min_rows(df, 2).count() == 1 and K.require_min_rows(df, 1).count() == 0
    assert {r.column: r.n_invalid for r in K.invalid_cells(df, ["mid"], ["symbol"]).collect()} == {"mid": 1}


def test_column_check_and_top_issues(spark):
    assert K.column_issue(quotes(spark).drop("bid_px"), ["ts_ms", "bid_px"], "quotes") == ["bid_px"]
    q = quotes(spark, bid_px=(3, 50.0))
    many = K.all_issues(*[K.quote_issues(q.withColumn("symbol", F.lit(s))) for s in "ABCD"])
    top = K.top_issues(many, 2).collect()
    assert [(r["rank"], r.symbol) for r in top] == [(1, "A"), (2, "B")]
