import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.functions import execution as X
from tickweave.operators import orders

L = F.lit


def walk(spark, side, notional, mid, top, depth):
    w = X.walk_book(L(side), L(float(notional)), L(float(mid)), L(float(top)), [L(float(d)) for d in depth])
    return spark.range(1).select(w.alias("w")).first().w


def brute(side, notional, mid, top, depth):
    left, cost, prev, edge = notional / mid, 0.0, 0.0, mid
    sizes = [max(depth[0], 0)] + [max(b - a, 0) for a, b in zip(depth, depth[1:])]
    for pct, size in zip((0.1, 0.2, 0.5, 1.0), sizes):
        far = mid * (1 + side * pct / 100)
        near = max(edge, top) if side > 0 else min(edge, top)
        take = min(left, size)
        cost, left, edge = cost + take * (near + far) / 2, left - take, far
    return (cost + max(left, 0) * edge) / (notional / mid), left > 1e-12


@pytest.mark.parametrize("side", [1, -1])
def test_walk_book_matches_brute_force(spark, side):
    rng = np.random.default_rng(side + 5)
    for _ in range(6):
        depth = np.sort(rng.uniform(0, 30, 4))
        mid = rng.uniform(50, 150)
        top = mid + side * rng.uniform(0, 0.05)
        notional = rng.uniform(10, 5000)
        w = walk(spark, side, notional, mid, top, depth)
        price, exhausted = brute(side, notional, mid, top, list(depth))
        assert w.price == pytest.approx(price, rel=1e-12) and w.exhausted == exhausted
        assert w.slippage == pytest.approx(max(side * (price - mid) / mid, 0), abs=1e-12)


def test_walk_book_edges(spark):
    w = walk(spark, 1, 0, 100, 100.1, [1, 2, 3, 4])
    assert (w.price, w.slippage, w.exhausted) == (100.1, 0.0, False)
    w = walk(spark, 1, 1e6, 100, 100.1, [1, 2, 3, 4])
    assert w.exhausted and w.price < 101.0
    thin, thick = walk(spark, 1, 1000, 100, 100.05, [1, 2, 3, 4]), walk(spark, 1, 1000, 100, 100.05, [100, 200, 300, 400])
    assert thick.price < thin.price


def test_a_best_price_of_zero_can_be_walked(spark):
    depth = [L(float(x)) for x in (1, 2, 3, 4)]
    for flag, price in ((False, 0.0), (True, 0.02 * 0.999 / 2)):
        w = X.walk_book(L(-1), L(0.01), L(0.02), L(0.0), depth, zero_top_is_price=flag)
        assert spark.range(1).select(w.alias("w")).first().w.price == pytest.approx(price)


def test_rounding(spark):
    def up(p, t, how):
        return spark.range(1).select(X.round_to_tick(L(p), L(t), how)).first()[0]
    assert up(10.3, 0.5, "up") == 10.5 and up(10.3, 0.5, "down") == 10.0
    # halves go to the even multiple
    assert up(1.25, 0.5, None) == 1.0 and up(1.75, 0.5, None) == 2.0
    assert up(10.3, 0.0, "up") == 10.3 and up(10.3, -1.0, "down") == 10.3


def test_market_fill_modes(spark):
    def fill(depth, cfg=X.CostConfig(), side=1, volume=1000.0):
        d = [L(x) for x in depth]
        f = X.market_fill(L(side), L(500.0), L(100.0), L(99.9), L(100.1), L(volume), L(0.5), d, d, cfg)
        return spark.range(1).select(f.alias("f")).first().f
    book = fill([10.0, 20.0, 30.0, 40.0])
    assert book.used_book and book.price == 100.5 and book.fee == pytest.approx(0.00035)
    for depth in ([0.0] * 4, [None] * 4, [-1.0, 1.0, 2.0, 3.0]):
        f = fill([L(x).cast("double") if x is None else x for x in depth])
        assert not f.used_book and f.slippage == pytest.approx(0.001 * math.sqrt(0.5))
    assert fill([0.0] * 4, X.CostConfig(zero_depth_is_book=True)).used_book
    assert fill([0.0] * 4, volume=0.0).slippage == 0.0
    assert fill([0.0] * 4, side=-1).price == 99.5


def test_limit_tests(spark):
    def t(side, post, bid, ask, vol=None, rest=None):
        q = {"volume": L(vol), "resting": L(rest)} if vol is not None else {}
        return spark.range(1).select(X.trade_through(L(side), L(post), L(bid), L(ask), **q)).first()[0]
    assert t(1, 100.0, 99.0, 100.0) and not t(1, 100.0, 99.0, 100.1)
    assert t(-1, 100.0, 100.0, 101.0) and not t(-1, 100.0, 99.9, 101.0)
    assert not t(1, 100.0, 99.0, 99.5, 5.0, 5.0) and t(1, 100.0, 99.0, 99.5, 5.1, 5.0)
    m = lambda s, a, b: spark.range(1).select(X.mid_move_fill(L(s), L(a), L(b), 1.0)).first()[0]
    assert m(1, 100.0, 99.99) and not m(1, 100.0, 99.995) and m(-1, 100.0, 100.02) and not m(1, 0.0, 1.0)


def test_funding_and_liquidation(spark):
    one = spark.range(1)
    assert one.select(X.funding_per_tick(L(0.0001), 1000)).first()[0] == pytest.approx(1e-7)
    assert one.select(X.funding_per_tick(L(float("nan")), 1000), X.funding_per_tick(L(0.1), 0)).first() == (0.0, 0.0)
    assert one.select(X.is_liquidated(L(-0.14), 6, 0.03), X.is_liquidated(L(-0.13), 6, 0.03), X.is_liquidated(L(-9.0), 0, 0.03)).first() == (True, False, False)


def queue_by_hand(rows):
    """The queue kept order by order."""
    out, queue = {}, []
    for tick, oid, is_market, leaves in rows:
        # before this order is handled, everything due by the previous tick has left from the head
        while queue and queue[0] <= tick - 1:
            queue.pop(0)
        if is_market:
            out[oid] = len(queue)
            queue = []
        queue.append(leaves)
    return out


@pytest.mark.parametrize("blocks", [1, 9])
def test_superseded_matches_a_queue(spark, blocks):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for s, n in (("HOT", 300), ("B", 40), ("NONE", 20)):
        ticks = np.sort(rng.choice(np.arange(2000), n, replace=False))
        mine = [(int(t), len(rows) + i, bool(rng.random() < 0.25) and s != "NONE", int(t + rng.integers(1, 60))) for i, t in enumerate(ticks)]
        want |= queue_by_hand(mine)
        rows += [(s, *m) for m in mine]
    df = spark.createDataFrame(rows, "symbol string, issue_tick long, order_id long, is_market boolean, execute_tick long")
    got = {r.order_id: r.n_cancelled for r in orders.superseded(df, blocks=blocks).collect()}
    assert got == want


def test_lookup_takes_volume_from_its_row_and_prices_from_the_next(spark):
    import datetime as dt

    d = dt.date(2024, 1, 1)
    s = spark.createDataFrame(
        [("X", d, 100 * i, 10.0 + i, 11.0 + i, 10.5 + i, float(i), 0.1 * i) for i in range(5)],
        "symbol string, day date, ts_ms long, bid_px double, ask_px double, mid double, abs_volume double, funding_rate double",
    )
    o = spark.createDataFrame([(1, "X", d, 130, 1, 100.0), (2, "X", d, 395, 1, 100.0)], "order_id long, symbol string, day date, ts_ms long, side int, notional double")
    cfg = X.CostConfig(latency_min=1, latency_max=1)
    got = orders.lookup(orders.schedule(o, 100, 0, cfg), s, 100).orderBy("order_id").collect()
    # the second order runs past the last row and stays unfilled
    assert [(r.order_id, r.issue_tick, r.execute_tick, r.row_volume, r.next_bid_px, r.status) for r in got] == [
        (1, 200, 300, 3.0, 14.0, "filled"), (2, 400, None, None, None, "unfilled"),
    ]


def test_midnight_is_no_border(spark):
    import datetime as dt

    days = [dt.date(2024, 1, 1 + i) for i in range(4)]
    ticks = {0: [0, 100, 200], 1: [1000], 3: [3000, 3100]}  # the third day has no row
    rows = [("X", days[i], t, t + 0.5, t + 1.0, t + 0.75, float(t), 0.0) for i, ts in ticks.items() for t in ts]
    s = spark.createDataFrame(
        rows, "symbol string, day date, ts_ms long, bid_px double, ask_px double, mid double, abs_volume double, funding_rate double"
    )
    o = [(1, days[0], 150), (2, days[0], 250), (3, days[1], 1000), (4, days[2], 2000), (5, days[3], 3001)]
    o = spark.createDataFrame([(i, "X", d, t, 1, 1.0) for i, d, t in o], "order_id long, symbol string, day date, ts_ms long, side int, notional double")
    cfg = X.CostConfig(latency_min=1, latency_max=1)
    got = orders.lookup(orders.schedule(o, 100, 0, cfg), s, 100).orderBy("order_id").collect()
    assert [(r.execute_tick, r.next_tick, r.status) for r in got] == [
        (1000, 3000, "filled"), (3000, 3100, "filled"), (3000, 3100, "filled"), (3100, None, "unfilled"), (None, None, "unfilled"),
    ]
    ahead = {r.ts_ms: [x and x.ts_ms for x in r._ahead] for r in orders.with_ahead(s, ["mid"], 3).collect()}
    assert ahead[200] == [1000, 3000, 3100] and ahead[1000] == [3000, 3100, None] and ahead[0] == [100, 200, 1000]


def test_latency_is_repeatable_and_covers_its_range(spark):
    df = spark.range(2000).select("id", orders.draw_latency(F.col("id"), 1, 1, 5).alias("l"))
    c = {r.l: r["count"] for r in df.groupBy("l").count().collect()}
    assert sorted(c) == [1, 2, 3, 4, 5] and min(c.values()) > 300
    assert df.repartition(7).agg(F.sum(F.col("id") * F.col("l"))).first() == df.agg(F.sum(F.col("id") * F.col("l"))).first()
    assert spark.range(1).select(orders.draw_latency(F.col("id"), 1, 0, 0)).first()[0] == 0


def test_limit_lifetime(spark):
    import datetime as dt

    d = dt.date(2024, 1, 1)
    ask = [12.0] * 5 + [9.5] + [12.0] * 14
    s = spark.createDataFrame(
        [("X", d, 100 * i, a - 1, a, 1.0) for i, a in enumerate(ask)], "symbol string, day date, ts_ms long, bid_px double, ask_px double, abs_volume double",
    )
    o = spark.createDataFrame(
        [(1, "X", d, 1, 0, 10.0), (2, "X", d, 1, 500, 10.0), (3, "X", d, 1, 400, 9.0), (4, "X", d, -1, 0, 11.0)],
        "order_id long, symbol string, day date, side int, post_tick long, post_price double",
    )
    got = {r.order_id: (r.filled, r.age) for r in orders.limit_lifetimes(o, s, 10).collect()}
    # the pricing row itself never fills; order 2 is posted on the dip and waits in vain
    assert got == {1: (True, 5), 2: (False, 10), 3: (False, 10), 4: (True, 1)}


def test_position_pnl(spark):
    legs = spark.createDataFrame(
        [(1, True, 1, 100.0, 0.001, 0.002, 0.0), (1, False, 1, 110.0, 0.001, 0.003, 0.0005), (2, True, -1, 100.0, 0.0, 0.0, 0.0)],
        "pid long, is_open boolean, side int, price double, fee double, slippage double, funding double",
    )
    r, left = orders.position_pnl(legs, ["pid"], leverage=6).orderBy("pid").collect()
    assert (left.status, left.gross_pnl, left.net_pnl) == ("open", None, None) and r.status == "closed"
    assert r.gross_pnl == pytest.approx(0.6) and r.net_pnl == pytest.approx(0.6 - 0.002 - 0.005 - 0.0005)
    r, _ = orders.position_pnl(legs, ["pid"], leverage=6, include_slippage=False).orderBy("pid").collect()
    assert r.net_pnl == pytest.approx(0.6 - 0.002 - 0.0005)


def test_market_fill_in_steps_compiles_and_equals_the_expression(spark):
    from tickweave.functions import execution as E

    rng = np.random.default_rng(11)
    rows = []
    for i in range(200):
        depth = np.sort(rng.integers(0, 9, 8)).astype(float)
        if i % 9 == 0:
            depth[:] = 0.0
        cells = [None if i % 17 == 0 and k == 5 else float(x) for k, x in enumerate(depth)]
        rows.append((i, int(rng.choice([-1, 1])), float(rng.integers(0, 900)), 100.0, 99.9, 100.1, float(rng.integers(0, 3) * 50), 0.5, *cells))
    ask, bid = [f"a{i}" for i in range(4)], [f"b{i}" for i in range(4)]
    names = ["i", "side", "notional", "mid", "bid", "ask", "volume", "tick", *ask, *bid]
    df = spark.createDataFrame(rows, "i int, side int, " + ", ".join(f"{n} double" for n in names[2:]))
    c = F.col
    before = spark.conf.get("spark.sql.codegen.fallback")
    # without the fallback a stage that can't be compiled fails the job
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for cfg in (E.CostConfig(), E.CostConfig(zero_depth_is_book=True), E.CostConfig(walk_book=False)):
            steps = E.with_market_fill(df, "fill", "side", "notional", "mid", "bid", "ask", c("volume"), "tick", ask, bid, cfg)
            assert steps.columns == [*names, "fill"]
            got = {r.i: r.fill for r in steps.select("i", "fill").collect()}
            spark.conf.set("spark.sql.codegen.fallback", "true")
            whole = E.market_fill(
                c("side"), c("notional"), c("mid"), c("bid"), c("ask"), c("volume"), c("tick"), [c(x) for x in ask], [c(x) for x in bid], cfg
            )
            want = {r.i: r.fill for r in df.select("i", whole.alias("fill")).collect()}
            spark.conf.set("spark.sql.codegen.fallback", "false")
            assert got == want
    finally:
        spark.conf.set("spark.sql.codegen.fallback", before)
