"""Token counts, with huge documents encoded in overlapping chunks.

A document up to ``chunk`` code points is encoded in one call. A longer one becomes rows
of chunks that overlap, dealt out to all tasks. Where two neighbours, in their overlap,
share two token borders ``p < q``, the tokens of the whole text are those of the left
chunk up to ``p`` and those of the right chunk from ``p`` on:

the encoder merges the best pair, leftmost first, until none is left. Let ``L``, ``M``,
``R`` be the text up to ``p``, from ``p`` to ``q`` and from ``q`` on. As long as no merge
of the whole text crosses ``p`` or ``q``, its three parts change as if they stood alone.
The first merge to cross ``p`` would join the last symbol of ``L`` with the first of
``M`` and would have happened in the left chunk too, which ends after ``q``; the first to
cross ``q`` would have happened in the right chunk. Neither did, so none does.

Where fewer than two borders agree, the document is cut anew with overlaps and chunks
four times as long, until the borders agree or one chunk holds the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, materialise, shards, small_batches

WIDEN = 4


class Borders:
    """Code points before each token, by a model that maps one code point to one (white space to U+2581)."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        byte = [int(p[3:5], 16) if self.model.is_byte(i) else -1 for i, p in enumerate(pieces)]
        self.inner = np.array([0x80 <= b < 0xC0 for b in byte])
        self.length = np.array(
            [0 if x else 1 if b >= 0 else len(p) for p, b, x in zip(pieces, byte, self.inner, strict=True)]
        )

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def borders(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and token numbers of all borders between code points, and the count of tokens."""
        ids = np.array(self.model.encode(text), np.int64)
        # the encoder puts one space before a text; a border after it counts as place 0
        place = np.r_[0, np.cumsum(self.length[ids])] - 1
        keep = np.r_[~self.inner[ids], True] & (place >= 0)
        return place[keep], np.flatnonzero(keep), len(ids)


def _spliced(long: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """``row, n_tokens`` of long texts; ``n_tokens`` is null where neighbours don't agree."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                whole = text.as_py()
                starts = range(0, max(1, len(whole) - overlap), chunk)
                for first in range(0, len(starts), 64):
                    part = starts[first : first + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row.as_py()] * len(part), pa.int64()),
                            pa.array(part, pa.int64()),
                            pa.array([whole[s : s + chunk + overlap] for s in part], pa.string()),
                        ],
                        ["row", "at", "text"],
                    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Borders(model)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for at, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                place, number, n = coder.borders(text)
                head, tail = place <= overlap, place >= chunk
                found = (place[head] + at, number[head], place[tail] + at, number[tail], n)
                for values, v in zip(out, found, strict=True):
                    values.append(v)
            kinds = [pa.list_(pa.int64())] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]],
                ["row", "at", "head", "head_no", "tail", "tail_no", "n"],
            )

    chunks = long.select("row", "text").mapInArrow(lean(cut), "row long, at long, text string").repartition("row", "at")
    ints = "array<long>"
    coded = chunks.mapInArrow(
        lean(encode), f"row long, at long, head {ints}, head_no {ints}, tail {ints}, tail_no {ints}, n long"
    )
    order = Window.partitionBy("row").orderBy("at")
    last = F.lead("at").over(order).isNull()
    pairs = coded.select(
        "row",
        "n",
        "tail",
        "tail_no",
        last.alias("last"),
        F.lead("head").over(order).alias("head"),
        F.lead("head_no").over(order).alias("head_no"),
    )
    common = F.array_intersect("tail", "head")
    pairs = pairs.withColumn("common", F.when(~F.col("last"), common))
    place = F.col("common")[0]
    agreed = F.col("last") | (F.size("common") >= 2)
    # tokens up to the border in the left chunk, less those before it in the right one
    gained = F.when(F.col("last"), F.col("n")).otherwise(
        F.element_at("tail_no", F.array_position("tail", place).cast("int"))
        - F.element_at("head_no", F.array_position("head", place).cast("int"))
    )
    return (
        pairs.select("row", agreed.alias("agreed"), F.when(agreed, gained).alias("gained"))
        .groupBy("row")
        .agg(F.when(F.every("agreed"), F.sum("gained")).alias("n_tokens"))
    )


def token_counts(
    docs: DataFrame,
    model: str,
    chunk: int = 32_768,
    overlap: int = 256,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts the tokens of whole texts without begin and end tokens; a null text is empty
    and has none. Ids may be null or repeated, and other columns are ignored. An empty
    table gives no rows. The model must map every code point to one code point, as models
    without normalisation do; :class:`Borders` relies on it for documents over ``chunk``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )
    whole = chunk + overlap

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Borders(model)
        for batch in shards(batches, "text"):
            texts = batch.column("text")
            long = pc.greater(pc.utf8_length(texts), whole)
            small = texts.filter(pc.invert(long)).to_pylist()
            counts = iter(coder.count(small))
            n = [None if x else next(counts) for x in long.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pc.binary_length(texts).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    # only long texts travel on
                    pa.array([t.as_py() if x.as_py() else None for t, x in zip(texts, long, strict=True)], texts.type),
                ],
                ["row", "doc_id", "n_bytes", "n_tokens", "text"],
            )

    counted = materialise(
        rows.mapInArrow(lean(count), f"row long, doc_id {kind}, n_bytes long, n_tokens long, text string"), "counts"
    )
    parts = [counted.where(F.col("n_tokens").isNotNull()).select("row", "n_tokens")]
    todo = counted.where(F.col("n_tokens").isNull()).select("row", "text")
    while not todo.isEmpty():
        tried = materialise(_spliced(todo, model, chunk, overlap), "spliced")
        parts.append(tried.where(F.col("n_tokens").isNotNull()))
        failed = tried.where(F.col("n_tokens").isNull()).select("row")
        if failed.isEmpty():
            break
        todo = todo.join(failed, "row", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return (
        counted.select("row", "doc_id", "n_bytes")
        .join(found, "row")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
