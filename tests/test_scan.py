import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.operators.asof import asof_join
from tickweave.operators.scan import BLOCK, Running, blocked, grid_positions, positions, scan


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    n = 600
    # one key holds most rows
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    x = rng.normal(size=n).round(3)
    return pd.DataFrame({"k": key, "t": np.arange(n) // 3, "s": np.arange(n), "x": np.where(rng.random(n) < 0.2, np.nan, x)})


def expected(p):
    p = p.sort_values(["k", "t", "s"]).copy()
    g = p.groupby("k")["x"]
    p["total"] = g.transform(lambda v: v.fillna(0).cumsum())
    p["n"] = g.transform(lambda v: v.notna().cumsum())
    p["top"] = g.transform(lambda v: v.fillna(-1e9).cummax()).where(p.n > 0)
    p["last"] = g.transform(lambda v: v.ffill())
    p["before"] = g.transform(lambda v: v.fillna(-1e9).cummax().shift(1))
    p["before"] = p["before"].where(p["before"] > -1e8)
    p["pos"] = p.groupby("k").cumcount()
    return p.sort_values("s").reset_index(drop=True)


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_running_values_do_not_depend_on_the_blocks(spark, frame, blocks):
    df = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    b = blocked(df, ["k"], ["t", "s"], blocks)
    assert b.select(BLOCK).distinct().count() <= blocks
    out = scan(
        b, ["k"], ["t", "s"],
        Running("total", "sum", F.col("x")),
        Running("n", "count", F.col("x")),
        Running("top", "max", F.col("x")),
        Running("last", "last", F.col("x")),
        Running("before", "max", F.col("x"), exclusive=True),
        Running("pos", "count", F.lit(1), exclusive=True),
    ).drop(BLOCK).toPandas().sort_values("s").reset_index(drop=True)
    want = expected(frame)
    assert len(out) == len(want)
    for c in ("n", "pos", "last", "before", "top"):
        pd.testing.assert_series_equal(out[c].astype(float), want[c].astype(float), check_names=False)
    assert np.allclose(out.total.fillna(0), want.total)


def test_a_hot_key_spans_blocks_and_the_carry_is_smaller_than_the_block_count(spark, frame):
    b = blocked(spark.createDataFrame(frame), ["k"], ["t", "s"], 16)
    spans = b.groupBy("k").agg(F.countDistinct(BLOCK).alias("n")).collect()
    assert max(r.n for r in spans) > 8
    assert sum(r.n - 1 for r in spans) < 16
    assert b.groupBy(BLOCK).count().agg(F.max("count")).first()[0] < 120


def test_positions_agree_with_grid_positions(spark, frame):
    df = spark.createDataFrame(frame).withColumn("part", F.floor(F.col("t") / 50))
    a = positions(df, ["k"], ["t", "s"], blocks=5).select("s", "pos").toPandas().set_index("s").pos
    b = grid_positions(df, "k", "part", "s").select("s", "pos").toPandas().set_index("s").pos
    assert (a.sort_index() == b.sort_index()).all()


def test_global_scan_without_keys(spark):
    df = spark.range(100).withColumn("v", F.col("id"))
    out = scan(blocked(df, [], ["id"], 7), [], ["id"], Running("c", "sum", F.col("v"))).toPandas().sort_values("id")
    assert (out.c.to_numpy() == np.arange(100).cumsum()).all()


@pytest.mark.parametrize("blocks", [1, 6])
def test_asof_join_keeps_inner_nulls_and_sees_equal_times(spark, blocks):
    src = spark.createDataFrame(
        [("a", 10, 1, 1.0), ("a", 20, 2, None), ("a", 20, 1, 5.0), ("a", 30, 3, 3.0), ("b", 5, 1, 9.0)],
        "k string, ts_ms long, rs long, v double",
    )
    probes = spark.createDataFrame(
        [("a", 9, 1), ("a", 10, 2), ("a", 19, 3), ("a", 20, 4), ("a", 29, 5), ("a", 99, 6), ("b", 4, 7), ("c", 50, 8)],
        "k string, ts_ms long, seq long",
    )
    out = asof_join(probes, src, ["k"], ["v"], right_seq="rs", blocks=blocks)
    got = {r.seq: r.v for r in out.collect()}
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: None, 5: None, 6: 3.0, 7: None, 8: None}
