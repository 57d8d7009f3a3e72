"""Toxicity scores by FTRL-proximal logistic regression over hashed word features.

Features are words, pairs of neighbours and pairs with one word between (skip-grams),
hashed to ``2**bits`` places; a document has a feature or not. Every coordinate learns at
its own rate, and L1 holds coordinates with little evidence at exactly zero, so the model
is a short list of places and weights that travels with the scoring tasks.

The model is fitted on at most ``train_rows`` labelled rows, the ones with the smallest
hashes of their ids; they, and nothing else, meet in one task. Scoring reads every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickweave.llm import hashing
from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, materialise, shards, small_batches

BITS = 20
TRAIN_ROWS = 16_000
HELD_OUT = 2
GAPS = (1, 2)


@dataclass(frozen=True)
class Model:
    """Non-zero weights by place, and the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int


def places(data: np.ndarray, borders: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of all documents, and their documents, with repeats."""
    word, doc, _ = hashing.words(hashing.FOLD[data], borders)
    shift = np.uint64(64 - bits)
    one = hashing.mix(word + np.uint64(1))
    found, owner = [(one >> shift).astype(np.int32)], [doc]
    for gap in GAPS:
        if len(word) > gap:
            same = doc[:-gap] == doc[gap:]
            pair = hashing.mix(hashing.mix(word[:-gap] + np.uint64(1 + gap)) + word[gap:])
            found.append((pair[same] >> shift).astype(np.int32))
            owner.append(doc[:-gap][same])
    return np.concatenate(found), np.concatenate(owner)


def distinct(place: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc.astype(np.int64) << bits) | place)
    return (key & ((1 << bits) - 1)).astype(np.int32), key >> bits


def ftrl(
    features: list[np.ndarray],
    labels: np.ndarray,
    bits: int,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 0.1,
    epochs: int = 4,
) -> Model:
    """Fit in the given order of rows; the bias has no penalty."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = bias_n = 0.0

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    for _ in range(epochs):
        for own, label in zip(features, labels.tolist(), strict=True):
            zi, ni = z[own], n[own]
            w = weights(zi, ni)
            g = _sigmoid(bias + w.sum()) - label
            z[own] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[own] = ni + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return Model(kept.astype(np.int32), w[kept], float(bias), bits)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def is_held_out(id_col: str, fold: int = HELD_OUT):
    """crc32 of the id as text, modulo 4; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == fold, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: int = TRAIN_ROWS,
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fit on at most ``train_rows`` labelled rows outside the held-out fold.

    Rows with a null label or id teach nothing; of repeated labels of an id the larger
    counts, of its repeated documents the one with the smallest hash of its text. Without any labelled row the model has no weights and gives 0.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )
    chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "train-ids")
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, "text"):
            data, borders = hashing.buffer(batch.column("text"))
            place, doc = distinct(*places(data, borders, bits), bits)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            own = [place[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("label"), pa.array(own, pa.binary())],
                ["doc_id", "label", "own"],
            )

    # at most train_rows ids: bounded, so they may be broadcast; of the rows of an id, one by the hash of its text
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    sample = joined.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    sample = small_batches(sample.select("doc_id", "label", "one.text"))
    rows = materialise(sample.mapInArrow(lean(features), "doc_id long, label int, own binary"), "train-features")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels = [], []
        for batch in batches:
            own += [np.frombuffer(x, np.int32) for x in batch.column("own").to_pylist()]
            labels += batch.column("label").to_pylist()
        model = ftrl(own, np.array(labels, float), bits)
        yield pa.RecordBatch.from_pydict(
            {
                "places": pa.array([model.places.tobytes()], pa.binary()),
                "weights": pa.array([model.weights.tobytes()], pa.binary()),
                "bias": pa.array([model.bias]),
            }
        )

    # ids in hash order, so the rows come in the same order whatever the partitions were
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "own")
    if rows.isEmpty():
        return Model(np.zeros(0, np.int32), np.zeros(0), -35.0, bits)
    row = one.mapInArrow(lean(train), "places binary, weights binary, bias double").collect()[0]
    return Model(np.frombuffer(row.places, np.int32), np.frombuffer(row.weights), row.bias, bits)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with a column ``name``, the chance of label 1 from 0 to 1; null and empty texts too.

    A column of that name in ``docs`` is replaced.
    """
    kept = docs.drop(name)
    schema = StructType([*kept.schema.fields, StructField(name, DoubleType())])
    used, weight, bias, bits = model.places, model.weights, model.bias, model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.zeros(1 << bits, bool)
        has[used] = True
        dense = np.zeros(1 << bits)
        dense[used] = weight
        for batch in shards(batches, text_col):
            data, borders = hashing.buffer(batch.column(text_col))
            place, doc = places(data, borders, bits)
            keep = has[place]
            place, doc = distinct(place[keep], doc[keep], bits)
            total = np.bincount(doc, dense[place], batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_sigmoid(bias + total))], [*batch.schema.names, name]
            )

    return small_batches(kept).mapInArrow(lean(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", **more) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``. See :func:`fit` and :func:`score`.

    An empty table gives no rows; repeated rows are scored each; other columns are ignored.
    """
    model = fit(docs, labels, id_col=id_col, **more)
    text_col = more.get("text_col", "text")
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return score(slim, model).select(
        "doc_id",
        is_held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
