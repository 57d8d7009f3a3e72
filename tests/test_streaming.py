"""Streams fed in several files give the batch answer; late rows are dropped."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import grid, ledger, rolling
from tickweave.operators.scan import blocked
from tickweave.session import new_path
from tickweave.streaming import run, ticks

G = 1000
DAY = 1_704_067_200_000
SCHEMA = "symbol string, day date, ts timestamp, ts_ms long, seq long, bid_px double, quantity double, signed_qty double"


def rows(n=120, seed=0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.choice(np.arange(0, 60_000), n, replace=False))
    t[5] = 7 * G  # exactly on a tick
    out = []
    for i, x in enumerate(np.sort(t)):
        q, s = float(rng.integers(1, 9)), rng.choice([-1, 1])
        out.append(("HOT" if rng.random() < 0.7 else "B", dt.date(2024, 1, 1), int(DAY + x), i, float(rng.integers(1, 99)), q, float(s * q)))
    return out


def frame(spark, data):
    df = spark.createDataFrame(data, "symbol string, day date, ts_ms long, seq long, bid_px double, quantity double, signed_qty double")
    return df.withColumn("ts", F.timestamp_millis("ts_ms")).select([c.split()[0] for c in SCHEMA.split(", ")])


CLOSE = ("_close", dt.date(2100, 1, 1), DAY + 10**12, -1, 1.0, 1.0, 1.0)


def stream(spark, slices):
    base = new_path(spark, "slices")
    for i, s in enumerate(slices):
        frame(spark, s).coalesce(1).write.parquet(f"{base}/{i}")
    return run.file_stream(spark, [f"{base}/*/*.parquet"], frame(spark, slices[0]).schema)


@pytest.fixture(scope="module")
def data():
    return rows()


def done(spark, df, label, mode="append"):
    return run.results(spark, run.run_to_end(df, label, mode)).where("symbol <> '_close'")


def same(a, b, cols):
    def norm(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())
    assert norm(a) == norm(b)


def slices(data):
    return [data[:30], data[30:35], data[35:90], data[90:], [CLOSE]]


def test_flow_equals_batch(spark, data):
    live = done(spark, ticks.trade_flow(stream(spark, slices(data)), G), "t-flow")
    same(live, grid.trade_buckets(frame(spark, data), G), ["symbol", "tick", "signed_volume", "abs_volume", "trade_count"])


def test_filled_quotes_equal_batch_across_batches(spark, data):
    cols = ["bid_px"]
    live = done(spark, ticks.fill_ticks(ticks.last_quotes(stream(spark, slices(data)), G, cols), G, cols), "t-fill")
    q = frame(spark, data).withColumns({"bid_sz": F.lit(1.0), "ask_px": F.col("bid_px") + 1, "ask_sz": F.lit(1.0)})
    same(live, grid.snapshots(q, grid_ms=G), ["symbol", "ts_ms", "bid_px"])


def test_rolling_equals_batch_across_batches(spark, data):
    w = {"a": 3, "b": 10}
    live = done(spark, ticks.rolling_flow(ticks.trade_flow(stream(spark, slices(data)), G), G, w), "t-roll")
    q = frame(spark, data).withColumns({"bid_sz": F.lit(1.0), "ask_px": F.col("bid_px") + 1, "ask_sz": F.lit(1.0)})
    batch = rolling.flow_features(grid.snapshots(q, frame(spark, data), grid_ms=G), w)
    # a trade on a tick belongs to the next bucket, so a stream that starts or ends on one differs at its edge
    names = ["symbol", "ts_ms", "ofi_a", "ofi_b", "trade_flow_imb_a", "trade_flow_imb_b"]
    same(live, batch, names)


def test_moments_equal_batch_after_many_updates(spark, data):
    live = run.results(spark, run.run_to_end(ticks.moments(stream(spark, slices(data)[:-1]), ["bid_px"]), "t-mom", "update"))
    assert live.count() > 2
    batch = frame(spark, data).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("bid_px").alias("mean_bid_px"), F.stddev_pop("bid_px").alias("std_bid_px"))
    same(run.latest(live, ["symbol"]), batch, ["symbol", "n", "mean_bid_px", "std_bid_px"])


def test_breaches_equal_batch_across_batches(spark, data):
    t = ticks.last_quotes(stream(spark, slices(data)), G, ["bid_px"], by=("symbol",)).withColumnRenamed("bid_px", "value")
    live = done(spark, ticks.breach_runs(t, hi=40.0, lo=20.0, k=2), "t-breach")
    up = F.col("ts_ms") + F.pmod(-F.col("ts_ms"), F.lit(G))
    b = frame(spark, data).groupBy("symbol", up.alias("tick")).agg(F.max_by("bid_px", "seq").alias("value"))
    batch = ledger.with_breach_runs(blocked(b, ["symbol"], ["tick"]), ["symbol"], ["tick"], F.col("value"), hi=40.0, lo=20.0, k=2)
    same(live, batch, ["symbol", "tick", "breach"])


def test_rows_behind_the_watermark_are_dropped(spark, data):
    late = ("HOT", dt.date(2024, 1, 1), DAY + 10, 999, 5.0, 1000.0, 1000.0)
    flow = ticks.trade_flow(stream(spark, [data[:60], data[60:], [late], [CLOSE]]), G, late="1 second")
    live = done(spark, flow, "t-late")
    assert live.agg(F.max("abs_volume")).first()[0] < 1000


def test_split_sends_every_row_to_one_sink(spark, data):
    out = run.run_to_end(stream(spark, slices(data)[:-1]), "t-split", batch=ticks.quality_split(F.col("bid_px") > 50))
    ok, bad = run.results(spark, out, "passed"), run.results(spark, out, "rejected")
    assert ok.count() + bad.count() == len(data)
    assert ok.agg(F.min("bid_px")).first()[0] > 50 >= bad.agg(F.max("bid_px")).first()[0]


def test_live_rows_of_an_unknown_key_stop_or_are_marked(spark):
    live = spark.createDataFrame([("X", 3.0), ("NEW", 5.0)], "symbol string, a double")
    stats = spark.createDataFrame([("X", 1.0, 2.0)], "symbol string, mean_a double, std_a double")
    with pytest.raises(Exception, match="no statistics for NEW"):
        ticks.live_zscore(live, stats, ["a"], 10.0).collect()
    got = {r.symbol: (r.a, r.known) for r in ticks.live_zscore(live, stats, ["a"], 10.0, known="known").collect()}
    assert got["X"] == (1.0, True) and got["NEW"][1] is False and got["NEW"][0] is None


def quote_rows(times, symbol="HOT", seed=3):
    """Rows at offsets of the first day; later offsets fall on later days."""
    rng = np.random.default_rng(seed)
    out = []
    for i, t in enumerate(times):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=int(t) // ticks.DAY_MS)
        out.append((symbol, day, int(DAY + t), i, float(rng.integers(1, 99)), 1.0, 1.0))
    return out


def test_a_silent_key_is_filled_by_its_timer(spark):
    """The watermark is moved on by another key; the silent one is filled up to it before its day ends."""
    silent, other = quote_rows([500, 1500], "QUIET"), quote_rows(range(2500, 60_000, 1000), "B")
    late = quote_rows([100_500], "B")
    q = stream(spark, [silent + other[:5], other[5:], late, late[:1]])
    live = ticks.fill_ticks(ticks.last_quotes(q, G, ["bid_px"], late="0 seconds"), G, ["bid_px"], silent_ms=10 * G)
    got = [r.ts_ms - DAY for r in done(spark, live, "t-silent").where("symbol = 'QUIET'").orderBy("ts_ms").collect()]
    assert got == list(range(1000, got[-1] + 1, G))
    assert 50_000 <= got[-1] <= 100_500


def test_the_end_of_a_day_fills_and_drops_the_state(spark):
    rows_ = quote_rows([ticks.DAY_MS - 5 * G + 1, ticks.DAY_MS - 4 * G])
    watch = []
    # the other key moves the watermark on, within the day and then past its end
    other = [quote_rows([ticks.DAY_MS - k * G], "B") for k in (3, 2)]
    q = stream(spark, [rows_, *other, [CLOSE], [CLOSE]])
    live = ticks.fill_ticks(ticks.last_quotes(q, G, ["bid_px"], late="0 seconds"), G, ["bid_px"], silent_ms=3600 * G)
    out = run.run_to_end(live, "t-expiry", watch=watch)
    got = run.results(spark, out).where("symbol = 'HOT'").orderBy("ts_ms").collect()
    assert [r.ts_ms - DAY for r in got] == [ticks.DAY_MS - k * G for k in range(4, -1, -1)]
    held = [o["numRowsTotal"] for p in watch for o in p["stateOperators"] if o["operatorName"] == "transformWithStateInPandasExec"]
    assert max(held) > 0 and held[-1] == 0


def dense_quotes(spark, data):
    q = frame(spark, data).withColumns({"bid_sz": F.lit(1.0), "ask_px": F.col("bid_px") + 1, "ask_sz": F.lit(1.0)})
    return grid.snapshots(q, grid_ms=G)


def test_price_features_equal_batch_across_batches(spark, data):
    w = {"a": 3, "b": 10}
    t = ticks.last_quotes(stream(spark, slices(data)).withColumn("bid_px", F.col("bid_px") + 0.5), G, ["bid_px"])
    live = done(spark, ticks.price_features(t.withColumnRenamed("bid_px", "micro_price"), G, w, 4), "t-price")
    batch = rolling.realised_vol(rolling.log_return(dense_quotes(spark, data), ticks=4), w)
    same(live, batch, ["symbol", "ts_ms", "micro_price_log_ret", "realized_vol_a", "realized_vol_b"])


def test_price_alerts_equal_batch_over_midnight(spark):
    from tickweave.operators import alerts

    rng = np.random.default_rng(7)
    edge = ticks.DAY_MS
    times = np.unique(np.r_[rng.integers(edge - 40_000, edge, 40), edge, rng.integers(edge, edge + 40_000, 40)])
    data = quote_rows(times)
    limits = {"jump": 0.4, "jump_ms": G, "crash": 0.3, "crash_ms": 5 * G, "cooldown_ms": 8 * G}
    t = ticks.last_quotes(stream(spark, [data[:25], data[25:60], data[60:], [CLOSE]]).withColumn("bid_px", F.col("bid_px") + 0.5), G, ["bid_px"])
    live = done(spark, ticks.price_alerts(t.withColumnRenamed("bid_px", "mid"), G, **limits), "t-alerts")
    batch = alerts.price_alerts(dense_quotes(spark, data), G, **limits)
    same(live, batch, ["symbol", "day", "ts_ms", "price_jump", "crash", "blocked"])
    assert batch.where("crash").count() and batch.where("not blocked").count()


def test_window_sums_keep_no_rest():
    x = np.array([1e16, 1.0, 1.0, 1.0, np.nan, 0.0, 0.0, 2.0])
    assert ticks.window_sums(x, 3).tolist()[3] == 3.0
    assert np.isnan(ticks.window_sums(x, 3)[[0, 1, 4, 5, 6]]).all() and ticks.window_sums(x, 3)[7] == 2.0
    assert ticks.window_sums(np.zeros(0), 3).tolist() == []


class _List:
    """A list state without Spark."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows_):
        self.rows = list(rows_)


def test_a_million_ticks_of_one_symbol_stay_small():
    """Beyond the incoming frames, at most 96 MB are held at a time, and the runs are those of one pass."""
    import tracemalloc

    import pandas as pd

    n, k = 1_000_000, 3
    rng = np.random.default_rng(2)
    tick, value = rng.permutation(n) * G, rng.random(n)

    def frames():
        for i in range(0, n, 10_000):
            yield pd.DataFrame({"symbol": "HOT", "tick": tick[i : i + 10_000], "value": value[i : i + 10_000]})

    p = ticks._BreachRuns(0.7, 0.1, k, ["symbol"])
    p.recent = _List()
    tracemalloc.start()
    found, seen = 0, -1
    for out in p.handleInputRows(("HOT",), frames(), None):
        assert len(out) <= ticks.CHUNK and out["tick"].iloc[0] > seen
        seen = out["tick"].iloc[-1]
        found += int(out["breach"].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    v = pd.Series(value[np.argsort(tick)])
    want = ((v > 0.7).rolling(k).sum() == k) | ((v < 0.1).rolling(k).sum() == k)
    assert found == int(want.sum()) and peak < 96 << 20


def test_streams_below_one_root(spark, tmp_path):
    for name in ("a", "b"):
        frame(spark, rows()[:3]).coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
    paths = [f"file://{tmp_path}/a/*.parquet", f"{tmp_path}/b/*.parquet"]
    df = run.file_stream(spark, paths, frame(spark, rows()[:1]).schema)
    assert run.results(spark, run.run_to_end(df, "t-roots")).count() == 6
    with pytest.raises(ValueError, match="one file system"):
        run.file_stream(spark, ["s3a://x/a", "hdfs://y/b"], df.schema)
