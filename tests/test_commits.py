from datetime import date

import pytest

from tickweave.sources import commits, tables, worklist


def frame(spark, rows):
    return spark.createDataFrame([(s, date(2024, 1, d), t, float(v)) for s, d, t, v in rows], "symbol string, day date, ts_ms long, v double")


def seen(spark, root, df):
    return sorted((r.symbol, r.day.day, r.ts_ms, r.v) for r in commits.read_committed(spark, root, df.schema).collect())


def test_a_run_shows_only_once_committed(spark, tmp_path):
    root = str(tmp_path / "t")
    old = [("a", 1, 1, 1), ("a", 1, 2, 2), ("a", 2, 3, 3)]
    df = frame(spark, old)
    assert seen(spark, root, df) == []
    commits.write_committed(df, root)
    assert seen(spark, root, df) == old
    # stopped between the write and the commit
    new = frame(spark, [("a", 2, 9, 9), ("b", 1, 5, 5)])
    run = commits.stage(new, root)
    assert seen(spark, root, df) == old
    plan = frame(spark, [("a", 1, 0, 0), ("a", 2, 0, 0), ("b", 1, 0, 0)]).select("symbol", "day")
    due = lambda: [(r.symbol, r.day.day) for r in worklist.pending(plan, commits.committed(spark, root, df.schema), keys=("symbol", "day")).collect()]
    assert due() == [("b", 1)]
    commits.commit(spark, root, run, df.schema)
    assert seen(spark, root, df) == [("a", 1, 1, 1), ("a", 1, 2, 2), ("a", 2, 9, 9), ("b", 1, 5, 5)]
    assert due() == []
    assert [r.n_rows for r in commits.committed(spark, root, df.schema).orderBy("symbol", "day").collect()] == [2, 1, 1]


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    root = str(tmp_path / "t")
    df = frame(spark, [("a", 1, 1, 1)])
    commits.write_committed(df, root)
    broken = df.withColumn("v", F.raise_error(F.lit("stopped")).cast("double"))
    with pytest.raises(Exception, match="stopped"):
        commits.write_committed(broken, root)
    assert seen(spark, root, df) == [("a", 1, 1, 1)]


def test_an_empty_run_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    df = frame(spark, [("a", 1, 1, 1)])
    commits.write_committed(df, root)
    commits.write_committed(df.limit(0), root)
    assert seen(spark, root, df) == [("a", 1, 1, 1)]


def test_footers_answer_without_reading_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(frame(spark, [("a", 1, 1, 1), ("a", 1, 4, -2), ("b", 2, 3, 3)]), path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")}
    got = tables.footer_facts(spark, path, ["ts_ms", "v"])
    assert sorted((r.symbol, r.n_rows, r.min_ts_ms, r.max_ts_ms, r.min_v, r.max_v) for r in got.collect()) == [
        ("a", 2, 1, 4, -2.0, 1.0), ("b", 1, 3, 3, 3.0, 3.0)
    ]
    assert {k: spark.conf.get(k) for k in before} == before
    try:
        spark.conf.set("spark.sql.sources.useV1SourceList", "csv,json")
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        query = tables._footer_query(spark.read.parquet(path), ["ts_ms"], ("symbol", "day"))
        plan = query._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "PushedAggregation: [COUNT(*), MIN(ts_ms), MAX(ts_ms)]" in plan.replace("COUNT(1)", "COUNT(*)")
