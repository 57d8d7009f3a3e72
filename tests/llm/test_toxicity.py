import zlib

import numpy as np
import pytest

from tests.llm.cases import ROWS, frame
from tickweave.llm import toxicity as module
from tickweave.llm.shared import documents
from tickweave.llm.toxicity import Model, ftrl, score, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = documents(spark, SF), documents(spark, SF, "labels")
    rows = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(rows[i].score, rows[i].predicted, y) for i, y in truth.items() if rows[i].held_out]
    s, p, y = map(np.array, zip(*held, strict=True))
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    precision, recall = (p & y).sum() / p.sum(), (p & y).sum() / y.sum()
    assert auc > 0.95 and precision > 0.9 and recall > 0.7
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert ((s >= 0) & (s <= 1)).all() and (p == (s >= 0.3)).all()


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = frame(spark, [(i, f"word{i} common text {'bad' if i % 3 == 0 else 'good'} end") for i in range(200)])
    truth = [(i, int(i % 3 == 0)) for i in range(200)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in truth]
    runs = [
        sorted(map(tuple, toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()))
        for x in (truth, turned)
    ]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("labels", [[], [(1, None), (None, 1)], [(1, 1), (1, 0), (6, 0), (7, 1)]])
def test_odd_rows(spark, labels):
    got = toxicity(frame(spark), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)


def test_empty_table(spark):
    assert toxicity(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_a_repeated_id_teaches_one_row(spark, monkeypatch):
    kept, real = {}, module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: kept.setdefault(name, real(df, name)))
    docs = frame(spark, [*[(1, f"text number {i}") for i in range(300)], (3, "one more text"), (3, None), (6, "and another")])
    module.fit(docs, spark.createDataFrame([(1, 1), (3, 0), (6, 0)], "doc_id long, toxic int"), train_rows=2)
    ids = [r.doc_id for r in kept["train-features"].collect()]
    assert 0 < len(ids) == len(set(ids)) <= 2


def test_l1_keeps_few_weights():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(1, 4096, 60)).astype(np.int32) for _ in range(600)]
    y = rng.integers(0, 2, 600)
    rows = [np.r_[r, np.int32(0)] if v else r for r, v in zip(rows, y, strict=True)]
    model = ftrl(rows, y.astype(float), 12)
    assert 0 in model.places.tolist() and len(model.places) < 400
    assert model.weights[model.places.tolist().index(0)] > 0


def test_score_keeps_columns(spark):
    out = score(frame(spark), Model(np.zeros(0, np.int32), np.zeros(0), 0.0, 10), name="chance")
    assert out.columns == [*frame(spark).columns, "chance"] and {r.chance for r in out.collect()} == {0.5}
