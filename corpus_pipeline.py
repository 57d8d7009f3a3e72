"""A training corpus from raw documents, in five stages; each reads what the one before it kept.

Every stage is one operator of ``tickweave.llm`` with its production parameters. All but
the last return the columns of ``documents``; a changed text gets its new ``n_chars``.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.llm.blobs import Bloom
from tickweave.llm.decontam import without_items
from tickweave.llm.line_dedup import dedup_lines
from tickweave.llm.ngram_join import near_duplicates
from tickweave.llm.packing import pack
from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, materialise, small_batches
from tickweave.llm.toxicity import fit, score

#: A document with at least this chance of being toxic is rejected.
TOXIC = 0.3
WINDOW = 4096
END = 2


def unused(name: str, docs: DataFrame) -> str:
    """``name``, longer as long as a column has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    model = fit(docs, documents(spark, sf_dir, "labels"))
    name = unused("score", docs)
    return score(docs, model, name=name).where(F.col(name) < TOXIC).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line resembles."""
    n_lines, n_removed = unused("n_lines", docs), unused("n_removed", docs)
    out = dedup_lines(docs, counts=(n_lines, n_removed))
    length = F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).drop(n_lines, n_removed)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one whose id names the group.

    Documents without words are linked with nothing and stay. Of rows that repeat an id one stays.
    """
    named = near_duplicates(docs).where("doc_id is not null")
    rows = F.count_if(F.col("doc_id") == F.col("component_id")).alias("rows")
    # ids of which not exactly one row names a group; all others stay where they are
    unclear = materialise(named.groupBy("doc_id").agg(rows).where("rows <> 1"), "unclear-ids")
    listed = Bloom.of(unclear.select(F.xxhash64("doc_id")))

    mark, names = unused("mark", docs), docs.columns
    marked = small_batches(docs.withColumn(mark, F.xxhash64(docs["doc_id"].cast("long"))))

    def part(inside: bool):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = listed.find(batch.column(mark).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(hit == inside)).select(names)

        return marked.mapInArrow(lean(choose), docs.schema)

    # only what the filter of fixed size finds is shuffled
    asked = part(True)
    kept = part(False).unionByName(asked.join(unclear, asked["doc_id"] == unclear["doc_id"], "left_anti"))
    again = unclear.where("rows > 1")
    if again.isEmpty():
        return kept
    repeated = asked.join(again, asked["doc_id"] == again["doc_id"], "left_semi")
    turn = unused("turn", docs)
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = repeated.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(turn)
    return kept.unionByName(one)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_items(docs, documents(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens, with their ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), END, WINDOW)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_windows),
]

#: The toxicity model and the tokenizer have no SQL form.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
