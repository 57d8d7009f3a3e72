import random

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.cases import ROWS
from tickweave import session
from tickweave.llm.registry import QUERIES
from tickweave.llm.shared import documents

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, SF)


def odd(spark, docs):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in ROWS]
    return spark.createDataFrame(rows, docs.schema).selectExpr("*", "1.5 as score", "2 as n_removed", "3 as turn")


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_order_of_stages():
    assert list(STAGES) == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]


def test_lines_go_and_documents_stay(spark, docs):
    rows = texts(docs)
    gone = brute.gone_lines(rows)
    want = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows]
    got = STAGES["line_dedup"](spark, docs, SF)
    assert got.columns == docs.columns and texts(got) == want
    assert got.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()


def test_one_document_of_each_group_stays(spark, docs):
    rows = texts(docs)
    names = brute.components(rows)
    got = STAGES["ngram_jaccard"](spark, docs, SF)
    assert got.columns == docs.columns and texts(got) == [(i, t) for i, t in rows if names[i][1] == i]


def test_leaks_go(spark, docs):
    items = [(r.item_id, brute.shingles(r.text)) for r in documents(spark, SF, "benchmark").collect()]
    rows = texts(docs)
    sets = {i: brute.shingles(t) for i, t in rows}
    leaky = {i for i, s in sets.items() for _, q in items if q and 5 * len(q & s) >= 4 * len(q)}
    got = STAGES["decontamination"](spark, docs, SF)
    assert leaky and texts(got) == [(i, t) for i, t in rows if i not in leaky]


def test_toxic_documents_go(spark, docs):
    got = texts(STAGES["toxicity"](spark, docs, SF))
    assert 0 < len(got) <= docs.count() and set(got) <= set(texts(docs))


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_and_empty_tables(spark, docs, name):
    table = odd(spark, docs)
    got = STAGES[name](spark, table, SF)
    if name != "packing":
        assert got.columns == table.columns
        ids = [r.doc_id for r in got.collect()]
        if name == "ngram_jaccard":
            # 2 repeats and is a copy of 1; 10 is a copy of 9, 7 of 6, 12 of 11; null ids stay
            assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 9, 11, 13] and ids.count(None) == 2
        if name == "line_dedup":
            assert len(ids) == len(ROWS)
    else:
        assert {r.doc_id for r in got.collect()} == {i for i, _ in ROWS}
    assert STAGES[name](spark, table.limit(0), SF).count() == 0


def test_run_keeps_what_the_stages_keep(spark):
    got = QUERIES["pipeline"](spark, SF)
    pieces = got.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert pieces and all(r["sum(length)"] == r["max(doc_tokens)"] for r in pieces)


def written(spark):
    """Bytes of shuffles that the session has written so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_texts_of_documents_without_copies_are_not_shuffled(spark, docs):
    rng = random.Random(7)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(1000))) for i in range(200)]
    # 0 has a copy with another id, and a row of id 5 comes twice
    rows += [(300, rows[0][1]), rows[5]]
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema).repartition(4)
    table.write.parquet(path := session.new_path(spark, "copies"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = STAGES["ngram_jaccard"](spark, spark.read.parquet(path), SF)
        start = written(spark)
        kept = texts(got)
        moved = written(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept == sorted(rows[:200])
    assert moved < sum(len(t) for _, t in rows) / 10
