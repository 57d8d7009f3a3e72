import datetime as dt

from pyspark.sql import functions as F

from tickweave.operators import alerts, ledger
from tickweave.operators.scan import blocked

D = dt.date(2024, 1, 1)


def test_price_alerts_and_cooldown(spark):
    mid = [100.0, 100.5, 102.0, 98.0, 98.0, 98.0, 98.0, 98.0]
    s = spark.createDataFrame([("X", D, 1000 * i, m) for i, m in enumerate(mid)], "symbol string, day date, ts_ms long, mid double")
    out = alerts.price_alerts(s, 1000, crash_ms=1000, cooldown_ms=2000).orderBy("ts_ms").collect()
    assert [r.price_jump for r in out] == [False, False, True, True, False, False, False, False]
    assert [r.crash for r in out] == [False] * 3 + [True] + [False] * 4
    assert [r.blocked for r in out] == [False] * 3 + [True] * 3 + [False] * 2


def test_a_crash_before_midnight_blocks_the_next_day(spark):
    rows = [("X", D, 1000 * i, 100.0) for i in range(3)] + [("X", D, 3000, 90.0)]
    rows += [("X", D + dt.timedelta(days=2), 4000 + 1000 * i, m) for i, m in enumerate([90.0, 90.0, 80.0, 80.0])]
    s = spark.createDataFrame(rows, "symbol string, day date, ts_ms long, mid double")
    out = alerts.price_alerts(s, 1000, crash_ms=2000, cooldown_ms=1500).orderBy("ts_ms").collect()
    # the move looks back over midnight, and the cooldown reaches over it
    assert [r.crash for r in out] == [False] * 3 + [True, True, False, True, True]
    assert [r.blocked for r in out] == [False] * 3 + [True, True, True, True, True]


def test_account_alerts(spark):
    pnl = [0.02, -0.01, -0.01, -0.01, 0.01, 0.5, 0.0]
    df = spark.createDataFrame([(1, 1000 * i, i, p) for i, p in enumerate(pnl)], "u int, ts_ms long, seq int, pnl double")
    for n in (1, 4):
        b = blocked(df, ["u"], ["ts_ms", "seq"], n)
        log = ledger.with_account(b, ["u"], ["ts_ms", "seq"], F.col("pnl"))
        out = alerts.account_alerts(log, ["u"], ["ts_ms", "seq"], losses=3, cooldown_ms=2000, trailing=0.025).orderBy("seq").collect()
        assert [r.loss_pause for r in out] == [False, False, False, True, True, True, False]
        # the stop holds after the value has recovered
        assert [r.drawdown_stop for r in out] == [False, False, False, True, True, True, True]


def test_outflow_and_exposure(spark):
    h = 3_600_000
    f = spark.createDataFrame(
        [("a", 0, -10.0, 100.0), ("a", 5 * h, -11.0, 90.0), ("a", 23 * h, 50.0, 80.0), ("a", 24 * h, -1.0, 130.0)],
        "account string, ts_ms long, amount double, value double",
    )
    out = alerts.outflow_alerts(f).orderBy("bucket_ms").collect()
    assert [r.outflow_day for r in out] == [10.0, 21.0, 21.0, 12.0]
    assert [r.redemption_pause for r in out] == [False, True, True, False]
    x = spark.createDataFrame([(0.001, 1, 100.0, 1000.0), (0.001, -1, 700.0, 100.0), (None, 1, 1.0, 0.0)], "r double, s int, n double, v double")
    got = [tuple(r[4:]) for r in alerts.exposure_alerts(x, "r", "s", "n", "v").collect()]
    assert got == [(True, False, False), (False, True, True), (False, False, False)]
