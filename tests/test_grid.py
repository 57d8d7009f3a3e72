import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.operators import grid

DAY = 1_704_067_200_000  # a midnight
Q = "symbol string, day date, ts_ms long, seq long, bid_px double, bid_sz double, ask_px double, ask_sz double"
T_ = "symbol string, day date, ts_ms long, seq long, price double, quantity double, is_buyer_maker boolean, signed_qty double"
D = "symbol string, day date, ts_ms long, seq long, percentage double, depth double, notional double"
FU = "symbol string, day date, ts_ms long, funding_rate double"


def day(ts):
    return pd.Timestamp(ts, unit="ms").date()


def quotes(spark, rows, symbol="X"):
    return spark.createDataFrame([(symbol, day(DAY + t), DAY + t, s, *p) for t, s, *p in rows], Q)


def trades(spark, rows, symbol="X"):
    return spark.createDataFrame([(symbol, day(DAY + t), DAY + t, i, 1.0, q, sg < 0, sg * q) for i, (t, q, sg) in enumerate(rows)], T_)


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("symbol", "day", "ts_ms").select((F.col("ts_ms") - DAY).alias("t"), *cols).collect()]


def test_grid_starts_after_an_unaligned_first_quote_and_ends_before_the_last(spark):
    q = quotes(spark, [(37, 1, 99.5, 1.0, 100.5, 1.0), (451, 2, 99.0, 1.0, 101.0, 1.0)])
    assert rows(grid.snapshots(q, grid_ms=100), "bid_px") == [(100, 99.5), (200, 99.5), (300, 99.5), (400, 99.5)]


def test_no_grid_between_two_ticks(spark):
    q = quotes(spark, [(37, 1, 1.0, 1.0, 2.0, 1.0), (61, 2, 1.0, 1.0, 2.0, 1.0)])
    assert rows(grid.snapshots(q, grid_ms=100)) == []


def test_last_by_sequence_wins_a_tie_whatever_the_row_order(spark):
    r = [(100, 3, 3.0, 1.0, 4.0, 1.0), (100, 9, 9.0, 1.0, 10.0, 1.0), (100, 5, 5.0, 1.0, 6.0, 1.0), (300, 10, 1.0, 1.0, 2.0, 1.0)]
    for order in (r, r[::-1]):
        assert rows(grid.snapshots(quotes(spark, order), grid_ms=100), "bid_px") == [(100, 9.0), (200, 9.0), (300, 1.0)]


def test_a_null_inside_the_newest_quote_is_not_filled_from_an_older_one(spark):
    q = quotes(spark, [(100, 1, 1.0, 7.0, 2.0, 1.0), (200, 2, 1.0, None, 2.0, 1.0), (300, 3, 1.0, 8.0, 2.0, 1.0)])
    assert rows(grid.snapshots(q, grid_ms=100), "bid_sz") == [(100, 7.0), (200, None), (300, 8.0)]


def test_trades_on_ticks_and_out_of_range(spark):
    q = quotes(spark, [(200, 1, 1.0, 1.0, 2.0, 1.0), (500, 2, 1.0, 1.0, 2.0, 1.0)])
    # before first - grid; inside the first bucket; on a tick; on the last tick
    t = trades(spark, [(99, 100.0, 1), (100, 1.0, 1), (199, 2.0, -1), (300, 4.0, 1), (500, 50.0, 1)])
    got = rows(grid.snapshots(q, t, grid_ms=100), "signed_volume", "abs_volume", "trade_count")
    assert got == [(200, -1.0, 3.0, 2), (300, 0.0, 0.0, 0), (400, 4.0, 4.0, 1), (500, 0.0, 0.0, 0)]


def test_flow_is_conserved_and_the_grid_reaches_the_last_trade(spark):
    rng = np.random.default_rng(1)
    q = quotes(spark, [(i * 47, i, 100.0, 1.0, 101.0, 1.0) for i in range(50)])
    ts = np.sort(rng.integers(10, 4900, 200))
    t = trades(spark, [(int(x), float(rng.integers(1, 9)), int(rng.choice([-1, 1]))) for x in ts])
    s = grid.snapshots(q, t, grid_ms=100)
    last = s.agg(F.max("ts_ms")).first()[0] - DAY
    assert last == int(ts[-1]) // 100 * 100
    inside = t.where(F.col("ts_ms") < DAY + last).agg(F.sum("signed_qty"), F.sum("quantity"), F.count("*")).first()
    assert s.agg(F.sum("signed_volume"), F.sum("abs_volume"), F.sum("trade_count")).first() == inside


def test_quote_columns(spark):
    q = quotes(spark, [(0, 1, 99.0, 3.0, 101.0, 1.0), (100, 2, 102.0, 0.0, 101.0, 0.0)])
    a, b = grid.snapshots(q, grid_ms=100).orderBy("ts_ms").collect()
    assert a.mid == 100.0 and a.micro_price == (99.0 * 1 + 101.0 * 3) / 4 and a.top1_size_imbalance == 0.5
    assert a.log_spread_bps == pytest.approx(np.log1p(0.02) * 1e4)
    # crossed and sizeless: no spread, no imbalance, plain mid
    assert (b.log_spread_bps, b.top1_size_imbalance, b.micro_price) == (0.0, 0.0, 101.5)


def test_the_wide_depth_row_is_carried_whole(spark):
    q = quotes(spark, [(0, 1, 1.0, 1.0, 2.0, 1.0), (400, 2, 1.0, 1.0, 2.0, 1.0)])
    d = [(50, 1, -0.1, 5.0), (50, 1, 1.0, 9.0), (50, 1, 3.3, 1.0), (150, 2, -0.1, 6.0), (150, 3, -0.1, 7.0), (150, 4, -0.1, None)]
    dep = spark.createDataFrame([("X", day(DAY), DAY + t, s, p, v, 0.0) for t, s, p, v in d], D)
    s = grid.snapshots(q, depth=dep, grid_ms=100)
    got = rows(s, "bid_depth_pct_neg_0_1", "ask_depth_pct_pos_1_0", "ask_depth_pct_pos_0_2")
    # the +1.0 level is missing in the newest row, so it is missing from then on
    assert got == [(0, None, None, None), (100, 5.0, 9.0, None), (200, 7.0, None, None), (300, 7.0, None, None), (400, 7.0, None, None)]


def test_of_two_books_at_one_time_the_larger_level_can_count(spark):
    q = quotes(spark, [(0, 1, 1.0, 1.0, 2.0, 1.0), (100, 2, 1.0, 1.0, 2.0, 1.0)])
    d = [(50, 1, -0.1, 8.0), (50, 2, -0.1, 6.0), (50, 1, 1.0, 5.0), (50, 2, 1.0, 9.0), (50, 3, 1.0, None)]
    dep = spark.createDataFrame([("X", day(DAY), DAY + t, s, p, v, 0.0) for t, s, p, v in d], D)
    cols = ("bid_depth_pct_neg_0_1", "ask_depth_pct_pos_1_0")
    assert rows(grid.snapshots(q, depth=dep, grid_ms=100, depth_seq="depth"), *cols)[-1] == (100, 8.0, 9.0)
    assert rows(grid.snapshots(q, depth=dep, grid_ms=100), *cols)[-1] == (100, 6.0, 9.0)


def test_absent_streams_give_null_depth_and_rate_and_zero_flow(spark):
    s = grid.snapshots(quotes(spark, [(0, 1, 1.0, 1.0, 2.0, 1.0)]), grid_ms=100).first()
    assert s.trade_count == 0 and s.abs_volume == 0.0 and s.funding_rate is None
    assert all(s[c] is None for c in schemas.DEPTH_LEVELS.values())


def test_rate_is_carried_across_days_or_missing_without_earlier_rows(spark):
    two = 2 * 86_400_000
    q = quotes(spark, [(100, 1, 1.0, 1.0, 2.0, 1.0), (two + 100, 2, 1.0, 1.0, 2.0, 1.0), (two + 300, 3, 1.0, 1.0, 2.0, 1.0)])
    def rate(rs):
        return spark.createDataFrame([("X", day(DAY + t), DAY + t, v) for t, v in rs], FU)
    s = grid.snapshots(q, funding=rate([(50, 0.1), (two + 250, 0.2)]), grid_ms=100)
    assert rows(s, "funding_rate") == [(100, 0.1), (two + 100, 0.1), (two + 200, 0.1), (two + 300, 0.2)]
    s = grid.snapshots(q, funding=rate([(two + 250, 0.2)]), grid_ms=100)
    assert [r[1] for r in rows(s, "funding_rate")] == [None, None, None, 0.2]


def test_same_answer_at_any_partition_count(spark):
    rng = np.random.default_rng(2)
    q = quotes(spark, [(int(t), i, float(p), 1.0, float(p) + 1, 2.0) for i, (t, p) in enumerate(zip(np.sort(rng.integers(0, 5000, 80)), rng.integers(1, 50, 80)))])
    want = None
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = rows(grid.snapshots(q.repartition(n), grid_ms=100), "bid_px", "micro_price")
        assert want is None or got == want
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_sequence_numbers_outside_the_packed_range_stop_the_job(spark):
    q = quotes(spark, [(100, 1 << 60, 1.0, 1.0, 2.0, 1.0)])
    with pytest.raises(Exception, match="packed range"):
        grid.snapshots(q, grid_ms=60_000).collect()


def test_raw_rows_are_reduced_by_hash_aggregation_before_the_shuffle(spark):
    plan = grid.snapshots(quotes(spark, [(0, 1, 1.0, 1.0, 2.0, 1.0)]), grid_ms=100)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_max_by" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
