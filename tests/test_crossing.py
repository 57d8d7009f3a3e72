import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import crossing, gates


def book(rng, n, symbol):
    mid = 100 + np.cumsum(rng.normal(0, 1, n))
    return [
        (symbol, i, None if rng.random() < 0.05 else float(mid[i] - 0.5), None if rng.random() < 0.05 else float(mid[i] + 0.5))
        for i in range(n)
    ]


def plain(rows, pos, side, price):
    if pos is None or price is None:
        return None
    for _, i, bid, ask in rows[pos + 1 :]:
        if (ask is not None and ask <= price) if side > 0 else (bid is not None and bid >= price):
            return i
    return None


@pytest.mark.parametrize("fan", [2, 5, 256])
def test_first_crossings_match_a_plain_search(spark, fan):
    rng = np.random.default_rng(fan)
    books = {s: book(rng, n, s) for s, n in (("a", 400), ("b", 37), ("c", 1))}
    rows = spark.createDataFrame([x for b in books.values() for x in b], "symbol string, _pos long, bid_px double, ask_px double")
    made = []
    for k in range(300):
        s = rng.choice(list(books))
        pos = int(rng.integers(len(books[s])))
        made.append((k, str(s), pos, int(rng.choice([-1, 1])), float(rng.normal(100, 15))))
    made += [(300, "a", None, 1, 100.0), (301, "a", 3, 1, None), (302, "gone", 0, 1, 100.0), (303, None, 0, 1, 100.0)]
    orders = spark.createDataFrame(made, "id long, symbol string, _pos long, side int, price double")
    got = crossing.first_crossings(orders, rows, fan=fan).collect()
    want = {i: plain(books.get(s, []), pos, side, price) for i, s, pos, side, price in made}
    assert {r.id: r["at"] for r in got} == want and len(got) == len(made)
    assert any(v is not None for v in want.values())


@pytest.mark.parametrize("max_age", [1, 10, 36_000])
def test_lifetimes_equal_the_unrolled_ones(spark, max_age):
    from datetime import date

    from tickweave.operators import orders as O

    rng = np.random.default_rng(4)
    mid = 100 + np.cumsum(rng.normal(0, 1, 60))
    snaps = spark.createDataFrame(
        [("a", date(2024, 1, 1 + i // 20), i * 1000, float(m - 0.5), float(m + 0.5), 1.0) for i, m in enumerate(mid)],
        "symbol string, day date, ts_ms long, bid_px double, ask_px double, abs_volume double",
    )
    posts = [(i, "a", date(2024, 1, 1 + i // 20), 1 if i % 2 else -1, i * 1000, float(mid[i])) for i in range(60)]
    posts += [(99, "a", date(2024, 1, 1), 1, None, None)]
    posts = spark.createDataFrame(posts, "order_id long, symbol string, day date, side int, post_tick long, post_price double")
    want = O.limit_lifetimes(posts, snaps, min(max_age, 60))
    got = crossing.crossing_lifetimes(posts, snaps, max_age, fan=4)
    fact = lambda df, most: {r.order_id: (r.filled, most if r.age is not None and not r.filled else r.age) for r in df.collect()}
    assert fact(got, max_age) == fact(want, max_age)


def test_merged_sketches_keep_their_bound(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("candidate"), (F.col("id") % 7).alias("batch"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 20_011).cast("double")).alias("reward"),
    )
    stored = gates.score_sketches(rows, ("candidate", "batch"))
    got = {r.candidate: r for r in gates.sketch_summary(gates.merged_sketches(stored)).collect()}
    data = rows.where("reward is not null").toPandas()
    for name, part in data.groupby("candidate"):
        x = np.sort(part.reward.to_numpy())
        assert got[name].n_episodes == len(x) and got[name].min_reward == x[0] and got[name].max_reward == x[-1]
        assert got[name].mean_reward == pytest.approx(x.mean())
        for q, v in ((0.5, got[name].median_reward), (0.05, got[name].p5_reward), (0.95, got[name].p95_reward)):
            assert abs(np.searchsorted(x, v) / len(x) - q) <= 0.01
    assert gates.sketch_summary(gates.score_sketches(rows.limit(0))).count() == 0
