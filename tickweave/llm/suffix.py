"""Removal of repeated byte strings by suffix arrays.

A byte goes when a string of ``length`` bytes that covers it starts at any other place too.
A suffix array of a whole corpus can't be built in one task, so the corpus is first dealt
out by content. In every string of ``length`` bytes the smallest of its ``gram``-byte hashes,
the leftmost on ties, is its anchor; equal strings have equal anchors. An anchor's context
is the run of text that its strings cover, so every string lies in one context. Only contexts
of anchors that occur more than once can hold a repeat; contexts that are equal in full are
settled by their count. The others meet in buckets by anchor, and each bucket sorts the
suffixes of its contexts that start a string:

* suffixes smaller than their successors are sorted directly, to the length that matters,
* the rest is induced by one scan over the buckets of first bytes,
* common prefixes of neighbours in the array show the strings that occur twice.

What a context finds is sent back to the documents that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import hashing
from tickweave.llm.blobs import BLOCKS, Bloom, Dealer, records, runs
from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, lean_group, materialise, partitions, shards, small_batches

#: Bytes of text that one vectorised step works on, few enough for a processor's cache.
STEP = 512 << 10
#: Bytes of contexts that meet in one bucket, about.
BUCKET = 256 << 10
RECORD = np.dtype([("key", "<u8"), ("c", "<u8"), ("n", "<u4")])


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row."""
    held, span = values, 1
    while 2 * span <= width:
        held = np.minimum(held[:-span], held[span:])
        span *= 2
    return np.minimum(held[: len(held) - (width - span)], held[width - span :]) if width > span else held


class Anchors:
    """Anchors of a batch of texts: document, hash, context and the bytes ``left:right`` of each."""

    def __init__(self, column: pa.Array, length: int, gram: int):
        self.data, self.borders = data, borders = hashing.buffer(column)
        self.doc = self.left = self.right = np.zeros(0, np.int64)
        self.key = self.context = np.zeros(0, np.uint64)
        size = np.diff(borders)
        has = size >= length
        if not has.any():
            return
        sums = hashing.prefix_sums(data)
        order = hashing.raw_hashes(sums, gram)
        order &= np.uint64(0xFFFFFFFF00000000)
        order |= np.arange(len(order), dtype=np.uint64)
        low = window_minimum(order, length - gram + 1)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[borders[:-1][has]] += 1
        np.add.at(inside, borders[1:][has] - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(inside[: len(low)], dtype=np.int8))
        at = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first, count = runs(at)
        at, self.left, self.right = at[first], starts[first], starts[first + count - 1] + length
        self.doc = np.searchsorted(borders, at, "right") - 1
        self.key = hashing.span_hash(data, sums, at, at + gram)
        whole = hashing.span_hash(data, sums, self.left, self.right)
        self.context = hashing.mix(whole + (at - self.left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of the ``wanted`` suffixes of ``text`` (bytes; all if not given), in order of their first ``depth`` bytes."""
    if len(text) == 0:
        return np.zeros(0, np.int64)
    text = np.r_[text, np.uint8(0)]
    n = len(text)
    # a suffix is small if it is less than the one after it; the added last one stands for the end
    step = np.sign(np.diff(text.astype(np.int16), append=-1))
    step[-1] = 1
    far = np.where(step != 0, np.arange(n), n - 1)
    small = step[np.minimum.accumulate(far[::-1])[::-1]] > 0
    if wanted is None:
        need = np.ones(n, bool)
    else:
        # a large suffix is induced from the one after it, so the run up to the next small one is needed too
        need = np.r_[wanted, False]
        ends = np.flatnonzero(need[:-1] & ~need[1:]) + 1
        stop = np.flatnonzero(small)[np.searchsorted(np.flatnonzero(small), ends - 1)]
        for k in range(int((stop - ends).max(initial=-1)) + 1):
            more = ends + k
            need[more[more <= stop]] = True
    place = np.flatnonzero(need)
    kind = small[place]
    order = place[kind]
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    head = np.zeros(len(order), np.uint64)
    for i in range(8):
        head = (head << np.uint64(8)) | wide[order + i]
    by = np.argsort(head, kind="stable")
    order, head = order[by], head[by]
    raw = text[:-1].tobytes()
    first, count = runs(head)
    for a, k in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
        order[a : a + k] = sorted(order[a : a + k].tolist(), key=lambda i: raw[i : i + depth])
    # the added end is smaller than all that starts with the same byte
    if need[-1]:
        order = np.r_[n - 1, order[order != n - 1]]
    # in a bucket of one first byte the large suffixes come before the small ones
    total, of_small = np.bincount(text[place], minlength=256), np.bincount(text[order], minlength=256)
    ends = np.cumsum(total)
    array = np.full(len(place), -1, np.int64)
    rank = np.arange(len(order)) - (np.cumsum(of_small) - of_small)[text[order]]
    array[(ends - of_small)[text[order]] + rank] = np.searchsorted(place, order)
    before = np.full(len(place), -1, np.int64)
    induced = (np.diff(place) == 1) & ~kind[:-1]
    before[1:][induced] = text[place[:-1][induced]]
    free, code, out = (ends - total).tolist(), before.tolist(), array.tolist()
    for j in range(len(out)):
        i = out[j]
        b = code[i]
        if b >= 0:
            out[free[b]] = i - 1
            free[b] += 1
    array = place[np.array(out)]
    return array[array < n - 1] if wanted is None else array[wanted[np.minimum(array, n - 2)] & (array < n - 1)]


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``depth``; both are that long."""
    # eight bytes from every place as one number; the first byte is the lowest
    eight = np.lib.stride_tricks.sliding_window_view(np.r_[text, np.zeros(7, np.uint8)], 8)
    wide = np.ascontiguousarray(eight).view("<u8").ravel()
    held, same = np.full(len(a), depth, np.int64), np.arange(len(a))
    for k in range(0, depth, 8):
        x = wide[a[same] + k] ^ wide[b[same] + k]
        differ = np.flatnonzero(x)
        # the lowest set bit lies in the first byte that differs
        low = x[differ] & (~x[differ] + np.uint64(1))
        held[same[differ]] = k + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
        same = same[x == 0]
    return np.minimum(held, depth)


def repeats(contexts: list[bytes], twice: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context the starts of its strings of ``length`` bytes that occur elsewhere.

    Contexts are distinct; ``twice`` marks those that occur more than once.
    """
    sizes = np.array([len(x) for x in contexts], np.int64)
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    edge = np.zeros(len(text) + 1, np.int64)
    edge[first] += 1
    edge[first + sizes - length + 1] -= 1
    array = suffix_array(text, length, np.cumsum(edge)[:-1] > 0)
    owner = np.searchsorted(first, array, "right") - 1
    joined = common_prefixes(text, array[:-1], array[1:], length) >= length
    begin = np.flatnonzero(np.r_[True, ~joined])
    size = np.diff(np.r_[begin, len(array)])
    many = np.repeat((size > 1) | np.logical_or.reduceat(twice[owner], begin), size)
    owner, offset = owner[many], (array - first[owner])[many]
    by = np.lexsort((offset, owner))
    owner, offset = owner[by], offset[by]
    cuts = np.searchsorted(owner, np.arange(len(contexts) + 1))
    return [offset[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def spans(starts: np.ndarray, length: int) -> np.ndarray:
    """Maximal covered runs ``from, to, from, to, ...`` of strings of ``length`` at sorted ``starts``."""
    if not len(starts):
        return starts
    new = np.flatnonzero(np.r_[True, np.diff(starts) > length])
    ends = np.r_[new[1:] - 1, len(starts) - 1]
    return np.stack([starts[new], starts[ends] + length], 1).ravel()


def covered(pieces: np.ndarray) -> np.ndarray:
    """Union of runs ``(from, to)``, touching runs joined."""
    pieces = pieces[np.argsort(pieces[:, 0], kind="stable")]
    ends = np.maximum.accumulate(pieces[:, 1])
    new = np.flatnonzero(np.r_[True, pieces[1:, 0] > ends[:-1]])
    return np.stack([pieces[new, 0], ends[np.r_[new[1:] - 1, len(pieces) - 1]]], 1)


def _facts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, th, at, size, key, c`` of the documents with anchors: places, sizes and names of contexts in arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, "text", STEP):
            a = Anchors(batch.column("text"), length, gram)
            cuts = pa.array(np.searchsorted(a.doc, np.arange(batch.num_rows + 1)), pa.int32())
            parts = (a.left - a.borders[a.doc], a.right - a.left, a.key.view(np.int64), a.context.view(np.int64))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v, pa.int64())) for v in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), *lists], ["doc_id", "th", "at", "size", "key", "c"]
            )

    longs = "at array<long>, size array<long>, key array<long>, c array<long>"
    return materialise(docs.mapInArrow(lean(run), f"doc_id long, th long, {longs}").where("size(c) > 0"), "anchors")


def _shared(facts: DataFrame) -> DataFrame:
    """``c, settled`` of contexts of repeated anchors; the settled ones occur twice and meet no other."""
    buckets = 2 * partitions(facts.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets)
        for batch in batches:
            c = batch.column("c").flatten().to_numpy().view(np.uint64)
            key = batch.column("key").flatten().to_numpy().view(np.uint64)
            # equal contexts of a batch travel as one; one context has one anchor
            one, where, n = np.unique(c, return_index=True, return_counts=True)
            out = np.empty(len(one), RECORD)
            out["key"], out["c"], out["n"] = key[where], one, np.minimum(n, 2)
            yield from dealer.add(out)
        yield from dealer.rest()

    def settle(table: pa.Table) -> pa.Table:
        r = records(table, RECORD)
        r = r[np.lexsort((r["c"], r["key"]))]
        first = np.flatnonzero(np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["c"][1:] != r["c"][:-1])])
        n = np.add.reduceat(r["n"].astype(np.int64), first)
        r = r[first]
        _, size = runs(r["key"])
        alone = np.repeat(size, size) == 1
        keep = ~alone | (n > 1)
        return pa.table(
            {
                "c": pa.array(r["c"][keep].view(np.int64)),
                "settled": pa.array(alone[keep]),
                "twice": pa.array(n[keep] > 1),
            }
        )

    dealt = facts.select("key", "c").mapInArrow(lean(deal), BLOCKS).groupBy("bucket")
    return materialise(dealt.applyInArrow(lean_group(settle), "c long, settled boolean, twice boolean"), "contexts")


def _found(docs: DataFrame, shared: DataFrame, length: int, gram: int) -> DataFrame:
    """``c, runs`` of contexts with repeats: covered runs relative to the anchor, null for all of the context."""
    settled = shared.where("settled").select("c", F.lit(None).cast("array<long>").alias("runs"))
    open_ = shared.where("not settled").select("c", "twice")
    if open_.isEmpty():
        return settled
    wanted = Bloom.of(open_.select("c"))
    # a context is about one and a half strings long
    buckets = max(partitions(docs.sparkSession), open_.count() * 3 * length // (2 * BUCKET))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in shards(batches, "text", STEP):
            a = Anchors(batch.column("text"), length, gram)
            context = a.context.view(np.int64)
            rows = []
            for i in np.flatnonzero(wanted.find(context)).tolist():
                if int(context[i]) not in seen:
                    seen.add(int(context[i]))
                    rows.append(i)
            raw = a.data.tobytes()
            bucket = ((a.key[rows] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            text = [raw[x:y] for x, y in zip(a.left[rows].tolist(), a.right[rows].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), pa.array(context[rows]), pa.array(text, pa.binary())],
                ["bucket", "c", "bytes"],
            )

    def search(table: pa.Table) -> pa.Table:
        _, one = np.unique(table.column("c").to_numpy(), return_index=True)
        table = table.take(pa.array(one))
        twice = table.column("twice").to_numpy(zero_copy_only=False).astype(bool)
        found = repeats(table.column("bytes").to_pylist(), twice, length)
        own = [None if t else spans(s, length) for s, t in zip(found, twice, strict=True)]
        keep = [i for i, s in enumerate(own) if s is None or len(s)]
        c = table.column("c").take(pa.array(keep, pa.int64()))
        return pa.table({"c": c, "runs": pa.array([own[i] for i in keep], pa.list_(pa.int64()))})

    met = docs.mapInArrow(lean(fetch), "bucket int, c long, bytes binary").join(open_, "c")
    found = met.select("bucket", "c", "bytes", "twice").groupBy("bucket").applyInArrow(lean_group(search), "c long, runs array<long>")
    return settled.unionByName(materialise(found, "repeats"))


def remove_repeats(
    docs: DataFrame, length: int = 400, gram: int = 64, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept``.

    Texts are their UTF-8 bytes, a null text is empty, and strings never cross documents.
    ``removed`` lists the maximal removed runs ``from, to, ...``; ``kept`` is the rest. Rows that
    repeat an id or a text are documents of their own. Other columns are ignored; an empty
    table gives no rows. A text shorter than ``length`` loses nothing.
    """
    slim = small_batches(docs).select(
        docs[id_col].cast("long").alias("doc_id"),
        F.xxhash64(docs[text_col].cast("string")).alias("th"),
        docs[text_col].cast("string").alias("text"),
    )
    facts = _facts(slim, length, gram)
    found = _found(slim, _shared(facts), length, gram)
    each = facts.select("doc_id", "th", F.explode(F.arrays_zip("at", "size", "c")).alias("a"))
    each = each.select("doc_id", "th", *[F.col(f"a.{x}").alias(x) for x in ("at", "size", "c")]).join(found, "c")
    each = each.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "size", "runs")).alias("hits"))
    hits = materialise(each, "hits")
    touched = Bloom.of(hits.select("th"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = batch.column("text").to_pylist()
            hits = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [None] * len(texts)
            for text, own in zip(texts, hits, strict=True):
                raw = (text or "").encode()
                pieces = []
                for hit in own or ():
                    at = hit["at"]
                    if hit["runs"] is None:
                        pieces.append((at, at + hit["size"]))
                    else:
                        r = hit["runs"]
                        pieces += [(at + x, at + y) for x, y in zip(r[::2], r[1::2], strict=True)]
                gone = covered(np.array(pieces, np.int64)).tolist() if pieces else []
                kept, last = [], 0
                for x, y in gone:
                    kept.append(raw[last:x])
                    last = y
                kept = b"".join([*kept, raw[last:]])
                away = len(raw) - len(kept)
                flat = [v for pair in gone for v in pair]
                rows.append((len(raw), away, len(gone), hashlib.sha256(kept).hexdigest(), flat, kept))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names
            )

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(touched.find(batch.column("th").to_numpy(zero_copy_only=False)) == inside))

        return run

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>, kept binary"
    clean, dirty = part(False), slim.mapInArrow(lean(part(True)), slim.schema)
    same = dirty["doc_id"].eqNullSafe(hits["doc_id"]) & (dirty["th"] == hits["th"])
    dirty = dirty.join(hits, same, "left").select(dirty["doc_id"], dirty["text"], hits["hits"])
    return slim.mapInArrow(lean(lambda batches: cut(clean(batches))), out).unionByName(dirty.mapInArrow(lean(cut), out))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("removed", "kept")
