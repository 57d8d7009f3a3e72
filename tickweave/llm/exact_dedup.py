"""Exact duplicates with a separate path for heavy hitters.

Texts are reduced to a digest once. Misra-Gries summaries, one per task and merged by
a sum, name every digest that may fill more than ``1 / (counters + 1)`` of the rows.
An exact count verifies them; the winners, at most ``counters`` rows, are broadcast and
settle their rows on the map side. Every other digest has a bounded number of rows and
takes one ordinary shuffle of digests. Texts are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prune(counts: Counter, counters: int) -> None:
    """Cut a summary to ``counters`` entries by taking the next largest count off all of them."""
    if len(counts) <= counters:
        return
    off = sorted(counts.values(), reverse=True)[counters]
    for k in [k for k, v in counts.items() if v <= off]:
        del counts[k]
    for k in counts:
        counts[k] -= off


def misra_gries(keys: DataFrame, column: str, counters: int) -> DataFrame:
    """Every value of ``column`` with more than ``rows / (counters + 1)`` rows, among at most ``counters`` values."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for pair in batch.column(0).value_counts():
                counts[pair["values"].as_py()] += pair["counts"].as_py()
            if len(counts) > 16 * counters:
                prune(counts, counters)
        prune(counts, counters)
        yield pa.RecordBatch.from_pydict(
            {"value": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}
        )

    parts = keys.select(column).mapInArrow(lean(summarise), "value binary, n long")
    merged = parts.groupBy("value").agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n")).limit(counters).select(F.col("value").alias(column))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after lower-casing A to Z; a null text is empty. The
    row with the largest id stays; a null id ranks below all others. Among repeated rows of
    that id exactly one stays. Other columns are ignored. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, UPPER, UPPER.lower()), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    keys = materialise(keys, "digests")
    rows = F.struct("doc_id", "row")
    limit = keys.count() / (counters + 1)
    suspects = materialise(misra_gries(keys, "digest", counters), "suspects")
    counted = (
        keys.join(F.broadcast(suspects), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(rows).alias("top"))
    )
    heavy = materialise(counted.where((F.col("group_size") > limit) & (F.col("group_size") > 1)), "heavy")
    settled = keys.join(F.broadcast(heavy), "digest")
    group = Window.partitionBy("digest")
    rest = keys.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "*", F.count("*").over(group).alias("group_size"), F.max(rows).over(group).alias("top")
    )
    return settled.unionByName(rest).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("top.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query(
    "op9_exact_dedup",
    """
    with d as (
        select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h
        from documents
    )
    select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
           doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
    from d
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))
