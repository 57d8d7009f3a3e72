import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.sources import logs, raw, tables, worklist


def put(path, text):
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


def test_quotes_fall_back_to_the_event_time(spark, tmp_path):
    p = put(tmp_path / "q.csv", " Best_Bid_Price,best_bid_qty,BEST_ASK_PRICE,best_ask_qty,event_time\n1.5,2,1.6,3,1000\nx,2,1.6,3,1100\n1,2,,3,1200\n")
    assert [tuple(r) for r in raw.parse(spark, "quotes", p).collect()] == [(1000, 1.5, 2.0, 1.6, 3.0)]
    assert raw.parse(spark, "quotes", p).schema.names == schemas.QUOTES.names


def test_trades_with_and_without_header(spark, tmp_path):
    body = "7,10.0,2.0,1,1,1000,true\n8,10.5,3.0,1,1,1001,False\n"
    a = put(tmp_path / "a.csv", "agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n" + body)
    b = put(tmp_path / "b.csv.gz", body)
    for p in (a, b):
        got = [tuple(r) for r in raw.parse(spark, "trades", p).orderBy("ts_ms").collect()]
        assert got == [(1000, 10.0, 2.0, True, -2.0), (1001, 10.5, 3.0, False, 3.0)]
    assert raw.parse(spark, "trades", [a, b]).count() == 4


def test_depth_time_is_utc(spark, tmp_path):
    p = put(tmp_path / "d.csv", "timestamp,percentage,depth,notional\n2024-01-01 00:00:01,-1,5,50\n")
    assert raw.parse(spark, "depth", p).first().ts_ms == 1704067201000


def test_one_bad_file_fails_alone(spark, tmp_path):
    good = put(tmp_path / "good.csv", "1,10.0,2.0,1,1,1000,true\n2,10.0,2.0,1,1,oops,true\n3,ten,2.0,1,1,1002,true\n")
    bad = put(tmp_path / "bad.csv", "nothing here\n")
    broken = tmp_path / "broken.csv.gz"
    broken.write_bytes(b"\x1f\x8b\x08\x00not a gzip body")
    r = {x.path.rsplit("/", 1)[-1]: x for x in raw.parse_report(spark, "trades", [good, bad, str(broken)]).collect()}
    assert (r["good.csv"].status, r["good.csv"].n_kept, r["good.csv"].n_bad_time, r["good.csv"].n_bad_value) == ("ok", 1, 1, 1)
    assert r["bad.csv"].status.startswith("ERR:") and r["broken.csv.gz"].status.startswith("ERR:")
    assert raw.parse(spark, "trades", [good, bad]).count() == 1
    with pytest.raises(Exception):
        raw.parse(spark, "trades", [good, str(broken)]).count()


def test_every_file_has_its_own_header(spark, tmp_path):
    a = put(tmp_path / "a.csv", "best_bid_price,best_bid_qty,best_ask_price,best_ask_qty,transaction_time\n1,2,3,4,1000\n")
    b = put(tmp_path / "b.csv", 'event_time,"best_ask_price",best_ask_qty,best_bid_qty,best_bid_price\n2000,3,4,2,1\n')
    got = sorted(map(tuple, raw.parse(spark, "quotes", [a, b]).collect()))
    assert got == [(1000, 1.0, 2.0, 3.0, 4.0), (2000, 1.0, 2.0, 3.0, 4.0)]
    t = put(tmp_path / "t.csv", "quantity,price,is_buyer_maker,transact_time\n2,10,false,5\n1,2\n")
    assert [tuple(r)[:3] for r in raw.parse(spark, "trades", t).collect()] == [(5, 10.0, 2.0)]


def test_truncated_file_is_an_error_and_stores_nothing(spark, tmp_path):
    folder = tmp_path / "X" / "trades"
    folder.mkdir(parents=True)
    whole = put(folder / "X-trades-2024-01-01.csv.gz", "".join(f"{i},10.0,2.0,1,1,{1000 + i},true\n" for i in range(50_000)))
    cut = folder / "X-trades-2024-01-02.csv.gz"
    data = open(whole, "rb").read()
    cut.write_bytes(data[: len(data) // 2])
    target = str(tmp_path / "out")
    report = {r.path: r for r in raw.ingest(spark, "trades", [whole, str(cut)], target).collect()}
    assert report[whole].status == "ok" and report[whole].n_kept == 50_000
    assert report[str(cut)].status.startswith("ERR:") and report[str(cut)].n_rows == 0
    days = tables.read_table(spark, target, schemas.TRADES).groupBy("day").count().collect()
    assert [(str(r.day), r["count"]) for r in days] == [("2024-01-01", 50_000)]


def test_ingest_stores_by_symbol_and_day(spark, tmp_path):
    paths = []
    for sym, day, text in (("X", "2024-01-01", "1,10.0,2.0,1,1,1000,true\n"), ("X", "2024-01-02", "junk\n"), ("Y", "2024-01-01", "1,5.0,1.0,1,1,7,false\n")):
        folder = tmp_path / sym / "trades"
        folder.mkdir(parents=True, exist_ok=True)
        paths.append(put(folder / f"{sym}-trades-{day}.csv", text))
    target = str(tmp_path / "out")
    report = raw.ingest(spark, "trades", paths, target)
    assert sorted(r.status[:3] for r in report.collect()) == ["ERR", "ok", "ok"]
    got = tables.read_table(spark, target, schemas.TRADES)
    assert sorted((r.symbol, str(r.day), r.signed_qty) for r in got.collect()) == [("X", "2024-01-01", -2.0), ("Y", "2024-01-01", 1.0)]


def stored(spark, path, days=("2024-01-01", "2024-01-02", "2024-01-03"), value=1.0):
    df = spark.createDataFrame([(1000 + i, value, 1.0, 2.0, 1.0, "X", date.fromisoformat(d)) for d in days for i in range(3)], tables.keyed(schemas.QUOTES))
    tables.write_table(df, path)


def test_rewards_without_lengths(spark, tmp_path):
    p = put(tmp_path / "r.json", json.dumps({"policy": "p", "seed": 1, "rewards": [1.0, 2.0]}))
    assert [(r.reward, r.length) for r in logs.read_rewards(spark, p).collect()] == [(1.0, None), (2.0, None)]


def test_table_round_trip_prunes_days_and_columns(spark, tmp_path):
    path = str(tmp_path / "quotes")
    stored(spark, path)
    t = tables.between_days(tables.read_table(spark, path, schemas.QUOTES), "2024-01-02", "2024-01-03")
    assert t.count() == 6 and tables.row_count(t) == 6
    plan = tables.columns(t, ["ts_ms"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "ReadSchema: struct<ts_ms:bigint>" in plan
    # writing one day again replaces that day only
    stored(spark, path, days=("2024-01-02",), value=9.0)
    t = tables.read_table(spark, path, schemas.QUOTES)
    assert t.count() == 9 and t.where("bid_px = 9").select("day").distinct().count() == 1


def test_named_symbols(spark, tmp_path):
    path = str(tmp_path / "quotes")
    stored(spark, path)
    t = tables.read_table(spark, path, schemas.QUOTES)
    assert tables.select_symbols(t, ["X"]).count() == 9
    with pytest.raises(FileNotFoundError, match="GONE"):
        tables.select_symbols(t, ["X", "GONE"])


def test_missing_tables(spark, tmp_path):
    gone = str(tmp_path / "gone")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, gone, schemas.QUOTES)
    empty = tables.read_table(spark, gone, schemas.TRADES, required=False)
    assert empty.count() == 0 and empty.columns == [*schemas.TRADES.names, "symbol", "day"]


def test_nan_becomes_null(spark):
    df = schemas.nan_to_null(spark.createDataFrame([(float("nan"), 1)], "a double, b int"))
    assert df.first() == (None, 1)


def test_latest_version(spark, tmp_path):
    for name, v in (("f-2024-01", 1.0), ("f-2024-03", 3.0), ("f-2024-02", 2.0)):
        import pyarrow as pa
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"ts_ms": [1], "funding_rate": [v]}), tmp_path / f"{name}.parquet")
    got = tables.latest_version(spark, str(tmp_path / "*.parquet"), schemas.FUNDING)
    assert [r.funding_rate for r in got.collect()] == [3.0]


def test_tail_of_a_stored_slab_is_pushed_down(spark, tmp_path):
    p = str(tmp_path / "slab")
    spark.range(100).withColumnRenamed("id", "pos").write.parquet(p)
    t = tables.stored_tail(spark.read.parquet(p), 7, 100)
    assert t.count() == 7
    assert "GreaterThanOrEqual(pos,93)" in t._jdf.queryExecution().executedPlan().toString()
    assert [r.pos for r in tables.first_rows(spark.read.parquet(p), 3, ["pos"]).collect()] == [0, 1, 2]


def test_mirror_difference(spark, tmp_path):
    for side, names in (("a", ["x/1.parquet", "x/2.parquet", "y/1.parquet"]), ("b", ["x/1.parquet"])):
        for n in names:
            f = tmp_path / side / n
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(b"abc")
    a, b = (tables.listing(spark, str(tmp_path / s)) for s in "ab")
    gone = tables.not_mirrored(a, b, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(r.name for r in gone.collect()) == ["x/2.parquet", "y/1.parquet"]
    assert tables.listing(spark, str(tmp_path / "a"), "/x/").count() == 2


def test_work_plan(spark):
    assert worklist.day_range(spark, "2024-02-28", "2024-03-01").count() == 3
    with pytest.raises(ValueError):
        worklist.day_range(spark, "2024-03-01", "2024-02-28")
    dim = worklist.asset_dimension(spark)
    syms = spark.createDataFrame([("SOLUSDT",), ("NEW",)], "symbol string")
    plan = worklist.task_plan(syms, ["quotes", "trades"], "2021-07-10", "2021-07-13", dim)
    assert {r.symbol: r["count"] for r in plan.groupBy("symbol").count().collect()} == {"SOLUSDT": 4, "NEW": 8}
    done = plan.where("stream = 'quotes'")
    assert worklist.pending(plan, done).select("stream").distinct().first().stream == "trades"
    assert worklist.pending(plan, done, overwrite=True).count() == 12
    res = spark.createDataFrame([("a", "ok"), ("b", "failed")], "task string, status string")
    assert {r.status: r.n for r in worklist.summarise(res).collect()} == {"ok": 1, "failed": 1}
    with pytest.raises(RuntimeError, match="1 tasks failed"):
        worklist.require_ok(res)


def episode(i, rewards):
    return {"episode_idx": i, "n_steps": len(rewards), "actions": [1] * len(rewards), "rewards": rewards, "cum_reward": sum(rewards), "obs_history": [[0.5, 1.0]] * len(rewards)}


def test_eval_logs(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"run_id": "r", "eval_idx": 1, "num_timesteps": 10, "episodes": [episode(0, [1.0, 2.0]), episode(1, [])]}, indent=1))
    (d / "b.json").write_text("{ not json")
    lg = logs.read_eval_logs(spark, str(d), multiline=True)
    steps = logs.episode_steps(lg)
    assert [(r.episode_idx, r.step, r.action, r.reward) for r in steps.orderBy("step").collect()] == [(0, 0, 1, 1.0), (0, 1, 1, 2.0)]
    assert logs.episode_totals(steps).first().cum_reward == 3.0
    assert logs.malformed(spark, str(d), multiline=True).first().source.endswith("b.json")
    assert logs.observations(lg, 2).count() == 2 and logs.observations(lg, 2, max_rows=1).count() == 1
    with pytest.raises(Exception, match="observation width"):
        logs.observations(lg, 3).collect()


def test_reward_files(spark, tmp_path):
    d = tmp_path / "rewards"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"policy": "p", "seed": 1, "rewards": [1.0, -2.0], "episode_lengths": [9000, 10]}, indent=1))
    got = logs.read_rewards(spark, str(d)).orderBy("episode").collect()
    assert [(r.policy, r.episode, r.reward, r.length) for r in got] == [("p", 0, 1.0, 9000), ("p", 1, -2.0, 10)]
    (d / "b.json").write_text(json.dumps({"policy": "q", "rewards": []}))
    with pytest.raises(schemas.ContractError, match="b.json"):
        logs.read_rewards(spark, str(d))


def test_records_are_written_as_json(spark, tmp_path):
    logs.write_records(spark.range(1).select(F.lit("v").alias("feature_version")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().feature_version == "v"


def test_rewards_split_over_files(spark, tmp_path):
    a = put(tmp_path / "a.json", json.dumps({"policy": "p", "seed": 1, "rewards": [1.0, 2.0], "episode_lengths": [5, 6], "first_episode": 0}))
    b = put(tmp_path / "b.json", json.dumps({"policy": "p", "seed": 1, "rewards": [3.0], "episode_lengths": [7], "first_episode": 2}))
    got = logs.read_rewards(spark, [a, b]).orderBy("episode").collect()
    assert [(r.episode, r.reward, r.length) for r in got] == [(0, 1.0, 5), (1, 2.0, 6), (2, 3.0, 7)]


def test_raw_files_by_header_and_width(spark, tmp_path):
    a = put(tmp_path / "a.csv", "transact_time,price,quantity,is_buyer_maker\n1000,10.0,2.0,true\n1001,10.0,2.0\n1002,10.0,2.0,true,9\n")
    b = put(tmp_path / "b.csv", '"price","quantity","is_buyer_maker","transact_time"\n"11.0","2.0","false","1003"\n')
    c = put(tmp_path / "odd name+1.csv", "transact_time,price,quantity,is_buyer_maker\n1004,12.0,2.0,true\n")
    report = {r.path: (r.status, r.n_rows, r.n_kept) for r in raw.parse_report(spark, "trades", [a, b, c]).collect()}
    assert report == {a: ("ok", 3, 1), b: ("ok", 1, 1), c: ("ok", 1, 1)}
    assert [r.ts_ms for r in raw.parse(spark, "trades", [a, b, c]).orderBy("ts_ms").collect()] == [1000, 1003, 1004]


def test_lines_that_are_no_header_are_not_sorted(spark, tmp_path):
    needed = ("price", "quantity", "transact_time", "is_buyer_maker")
    a = put(tmp_path / "a.csv", "price,quantity,transact_time,is_buyer_maker\n10,2,5,false\n")
    b = put(tmp_path / "b.csv", "1,10.0,2.0,1,1,1000,true\n")
    put(tmp_path / "c.csv", "")
    groups = raw._headers(spark, str(tmp_path), needed)
    assert {h: [f.rsplit("/", 1)[-1] for f in fs] for h, fs in groups.items()} == {
        "price,quantity,transact_time,is_buyer_maker": ["a.csv"], None: ["b.csv"]
    }
    lines = spark.read.text([a, b]).select("value", F.col("_metadata.file_path").alias(raw.FILE))
    plan = raw._header_lines(lines, needed)._jdf.queryExecution().executedPlan().toString()
    # the lines are counted below every sort
    assert plan.rindex("HashAggregate") > plan.rindex("Sort")
