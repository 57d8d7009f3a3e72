"""Packing of documents into fixed windows by multiway Karmarkar-Karp differencing.

A task tokenises its documents and packs them in blocks of ``block`` pieces, so nothing
is shuffled and memory is bounded by one block. A document is cut at full windows; what
remains of it, shorter than a window, is one piece. In a block every piece starts as a
partial partition of its own. The two partial partitions with the largest imbalance are
merged again and again, the fullest window of one with the emptiest of the other, until
one partition is left. For whole pieces the count of windows rises as long as one is above
capacity. Where pieces may be cut, what is above the capacity of all windows is taken off
first and carried to the next block, and what the near-equal windows have too much moves
to those that have too little; the last rest of a task fills windows that are powers of two.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, shards, small_batches
from tickweave.llm.vocabulary import WordIds

Cut = tuple[int, int, int]  # item, start in it, length
#: Windows of an Arrow batch.
BATCH = 64
#: Bytes of text that are encoded at a time; fewer meet more words anew.
STEP = 2 << 20


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Indexes of the items in each of ``windows`` near-equal windows."""
    n = len(sizes)
    if windows <= 1 or n == 0:
        return [list(range(n))]
    left, right = [-1] * n, [-1] * n
    # a partial partition: sums of its filled windows, largest first, and the node that each holds
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over > 0:
            # the last `over` windows of one meet the last ones of the other, in opposite order
            s, t = a[len(a) - over :], b[len(b) - over :][::-1]
            made = np.arange(len(left), len(left) + over)
            left.extend(x[len(x) - over :].tolist())
            right.extend(y[len(y) - over :][::-1].tolist())
            sums = np.r_[a[: len(a) - over], s + t, b[: len(b) - over]]
            nodes = np.r_[x[: len(x) - over], made, y[: len(y) - over]]
        else:
            sums, nodes = np.r_[a, b], np.r_[x, y]
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        low = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (-int(sums[0] - low), turn, sums, nodes))
        turn += 1
    out = []
    for node in heap[0][3].tolist():
        items, todo = [], [node]
        while todo:
            k = todo.pop()
            if k < n:
                items.append(k)
            else:
                todo += [left[k], right[k]]
        out.append(sorted(items))
    return out


def whole_windows(sizes: np.ndarray, capacity: int) -> list[list[Cut]]:
    """Near-equal windows of uncut items; one more window as long as one is above ``capacity``."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        groups = differencing(sizes, windows)
        if all(sizes[g].sum() <= capacity for g in groups):
            return [[(i, 0, int(sizes[i])) for i in g] for g in groups if g]
        windows += 1


def full_windows(sizes: np.ndarray, capacity: int) -> tuple[list[list[Cut]], list[Cut]]:
    """Windows that are full to the last token, and what is left over, less than one window."""
    windows, rest = divmod(int(sizes.sum()), capacity)
    kept, over = sizes.copy(), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        if rest == 0:
            break
        n = min(rest, int(kept[i]))
        kept[i] -= n
        rest -= n
        over.append((i, int(kept[i]), n))
    if windows == 0:
        return [], over
    made, loose = [], []
    for group in differencing(kept, windows):
        cuts = [(i, 0, int(kept[i])) for i in group if kept[i]]
        cuts.sort(key=lambda c: c[2])
        much = sum(c[2] for c in cuts) - capacity
        while much > 0:
            i, start, n = cuts.pop()
            off = min(much, n)
            loose.append((i, start + n - off, off))
            if n > off:
                cuts.append((i, start, n - off))
            much -= off
        made.append(cuts)
    for cuts in made:
        lack = capacity - sum(c[2] for c in cuts)
        while lack > 0:
            i, start, n = loose.pop()
            take = min(lack, n)
            cuts.append((i, start, take))
            if n > take:
                loose.append((i, start + take, n - take))
            lack -= take
    return made, over


def powers(cuts: list[Cut]) -> list[list[Cut]]:
    """Deal ``cuts`` out to windows whose lengths are powers of two, the largest first."""
    cuts, total, out = cuts[::-1], sum(c[2] for c in cuts), []
    for bit in reversed(range(total.bit_length())):
        lack, window = total & (1 << bit), []
        while lack > 0:
            i, start, n = cuts.pop()
            take = min(lack, n)
            window.append((i, start, take))
            if n > take:
                cuts.append((i, start + take, n - take))
            lack -= take
        if window:
            out.append(window)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = 4096,
    block: int = 1024,
    cut: bool = True,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, its checksum and its ids.

    A document is the ids of its whole text and ``end_id``; a null or empty text is
    ``end_id`` alone. ``start`` counts the document's ids before the piece, ``offset`` the
    ids before it in its sequence, ``ids`` are little-endian unsigned 32-bit numbers. With
    ``cut`` every sequence is full or a power of two long; without it, documents up to one
    window stay whole and sequences are near-equal. Ids may be null or repeated: every row is
    a document of its own. Sequences never reach over tasks. Other columns are ignored; an
    empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(
        docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")
    )
    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + ", ids binary" * with_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = WordIds(tokenizer), TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # document, start, ids, tokens of the document
        id_type = None

        def emit(windows: list[list[Cut]], pieces: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in range(8 if with_ids else 7)]
            for cuts in windows:
                offset = 0
                for i, start, n in cuts:
                    doc, first, ids, total = pieces[i]
                    part = ids[start : start + n].astype("<u4").tobytes()
                    row = (doc, first + start, n, zlib.crc32(part), total, number, offset, part)
                    for values, v in zip(out, row, strict=False):
                        values.append(v)
                    offset += n
                number += 1
            types = [id_type, *[pa.int64()] * 6, pa.binary()][: len(out)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, types, strict=True)], names[: len(out)]
            )

        def settled() -> tuple[list[list[Cut]], list[tuple]]:
            nonlocal held
            pieces, sizes = held, np.array([len(p[2]) for p in held], np.int64)
            if not cut:
                held = []
                return whole_windows(sizes, window), pieces
            made, over = full_windows(sizes, window)
            held = [
                (pieces[i][0], pieces[i][1] + start, pieces[i][2][start : start + n].copy(), pieces[i][3])
                for i, start, n in over
            ]
            return made, pieces

        def flush() -> Iterator[pa.RecordBatch]:
            made, pieces = settled()
            for i in range(0, len(made), BATCH):
                yield emit(made[i : i + BATCH], pieces)

        for batch in shards(batches, "text", STEP):
            id_type = batch.schema.field("doc_id").type
            ids, borders = encode(batch.column("text"))
            full: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), borders[:-1], borders[1:], strict=True):
                own = np.append(ids[a:b], np.uint32(end_id))
                at = 0
                while len(own) - at >= window:
                    full.append((doc, at, own[at : at + window], len(own)))
                    at += window
                if at < len(own):
                    # a copy, so that the piece does not hold on to a long document
                    held.append((doc, at, own[at:].copy(), len(own)))
                    if len(full) >= BATCH:
                        yield emit([[(i, 0, window)] for i in range(len(full))], full)
                        full = []
                if len(held) >= block:
                    yield from flush()
            if full:
                yield emit([[(i, 0, window)] for i in range(len(full))], full)
        if held:
            yield from flush()
        if held:
            yield emit(powers([(i, 0, len(p[2])) for i, p in enumerate(held)]), held)

    return rows.mapInArrow(lean(run), schema)


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, with_ids=False)
