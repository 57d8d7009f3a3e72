"""Alignment of two tokenizations of the same text by their common byte ends.

Each token list gives a dictionary from the byte at which a token ends to its index. The
ends in both dictionaries, sorted, slice both id lists into groups; in a group every token
of one list is linked with the tokens of the other whose bytes overlap it.

Both models have a token end wherever a single space stands between two characters that are
not white space: the byte model starts a word there, and no piece of the other has white space
after anything else (:class:`Models` makes sure of that). A text is cut there first, so a
segment's groups and links don't depend on its neighbours, and each distinct segment of a
block is aligned once.

The links of a pair of ids are counted over the whole corpus: blocks add up their pairs and
ask the owners of the pairs for the totals (``exchange``). The largest count of each id of
the second model is an array as long as its vocabulary, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tickweave.llm import exchange
from tickweave.llm.blobs import SLICES, SUMMARY, merged, slices
from tickweave.llm.hashing import buffer
from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, materialise, shards, small_batches

# printable ASCII and the bytes of U+00C0-U+00FF and U+0400-U+047F, none of which is white space
_HEAD, _TAIL = np.zeros(256, bool), np.zeros(256, bool)
_HEAD[33:127] = _HEAD[[0xC3, 0xD0, 0xD1]] = True
_TAIL[33:127] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC3, 0xD0, 0xD1]] = True

#: Bytes of segments that are encoded as one text.
RUN_BYTES = 1 << 15


def slices_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """The common ends, sorted, and how many tokens of either list stand before each: the borders of the groups."""
    a_index = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1), strict=True))
    b_index = dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_index.keys() & b_index.keys())
    return np.array(common, np.int64), [a_index[e] for e in common], [b_index[e] for e in common]


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """End, first index and second index of all overlaps of tokens, slice by slice.

    Inside a slice an overlap ends where one of its two tokens does, and no other overlap ends
    there: every end of either list closes one link.
    """
    # two sorted runs, which a stable sort merges
    ends = np.sort(np.r_[a_ends, b_ends], kind="stable")
    ends = ends[np.r_[ends[1:] != ends[:-1], True]] if len(ends) else ends
    return ends, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Models:
    """A byte-level BPE of tokenizers and a sentencepiece model, with the bytes of their tokens."""

    def __init__(self, byte_model: str, piece_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_model)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain}
        # the bytes left over stand for 256, 257 and so on, in order
        letters |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letters)}
        byte = {c: b for b, c in letters.items()}
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = {i: bytes(byte[c] for c in name if c in byte) for name, i in names.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, x in self.a_bytes.items():
            self.a_sizes[i] = len(x)
        self.b_sizes = np.array(list(map(len, self.b_bytes)), np.int64)
        self.cuts = not any(" " in p.lstrip("▁").replace("▁", " ") for p in pieces)

    def coded(self, segments: list[bytes], alone: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Segments in the order of their tokens, and the ids of both models; those not spelt by their tokens are left out.

        Neighbours that don't touch each other's tokens are encoded as one text; ``alone`` marks the others.
        """
        runs, run, size = [], [], 0
        for i, x in enumerate(alone.tolist()):
            if x:
                runs.append([i])
                continue
            run.append(i)
            size += len(segments[i])
            if size >= RUN_BYTES:
                runs.append(run)
                run, size = [], 0
        runs += [run] * bool(run)
        order, a_ids, b_ids = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while runs:
            part, runs = runs[:64], runs[64:]
            data = [b"".join([segments[i] for i in r]) for r in part]
            texts = [d.decode() for d in data]
            coded = self.a.encode_batch_fast(texts, add_special_tokens=False)
            pieces = self.b.encode([t[1:] for t in texts], num_threads=1)
            for r, d, x, b in zip(part, data, coded, pieces, strict=True):
                a = x.ids
                if b"".join([self.a_bytes[i] for i in a]) == d and b"".join([self.b_bytes[i] for i in b]) == d:
                    order += r
                    a_ids.append(np.array(a, np.int64))
                    b_ids.append(np.array(b, np.int64))
                elif len(r) > 1:
                    runs += [[i] for i in r]
        return order, np.concatenate(a_ids), np.concatenate(b_ids)

    def align(self, segments: list[bytes], alone: np.ndarray) -> Aligned:
        """The alignment of every segment; one that its tokens don't spell is marked and has none."""
        n = len(segments)
        order, a, b = self.coded(segments, alone)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        common, a_to, b_to = slices_of(a_ends, b_ends)
        x, y, groups, i, j = list(map(str, a.tolist())), list(map(str, b.tolist())), [], 0, 0
        for k, m in zip(a_to, b_to, strict=True):
            if k - i == 1 and m - j == 1:
                groups.append(x[i] + "|" + y[j])
            else:
                groups.append(",".join(x[i:k]) + "|" + ",".join(y[j:m]))
            i, j = k, m
        ends, first, second = links_of(a_ends, b_ends)
        borders = np.r_[0, np.cumsum([len(segments[i]) for i in order])].astype(np.int64)
        # every segment border is an end of both
        at = [np.searchsorted(e, borders, "right") for e in (a_ends, b_ends, common, ends)]
        counts = np.zeros((4, n), np.int64)
        counts[:, order] = [np.diff(x) for x in at]
        texts = [""] * n
        for k, i, j in zip(order, at[2][:-1].tolist(), at[2][1:].tolist(), strict=True):
            texts[k] = groups[i] if j - i == 1 else ";".join(groups[i:j])
        spelt = np.zeros(n, bool)
        spelt[order] = True
        # links by segment, in the order of the segments
        own = np.repeat(np.array(order, np.int64), np.diff(at[3]))
        keys = (a[first] << 32 | b[second]).astype(np.uint64)[np.argsort(own, kind="stable")]
        return Aligned(*counts, texts, keys, spelt)


class Aligned(NamedTuple):
    """Counts of tokens, groups and links of segments, their groups as text, the id pairs of all links in a row."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    texts: list[str]
    keys: np.ndarray
    spelt: np.ndarray

    def __add__(self, other: Aligned) -> Aligned:
        join = lambda x, y: x + y if isinstance(x, list) else np.concatenate([x, y])
        return Aligned(*[join(x, y) for x, y in zip(self, other, strict=True)])


def _cut(data: np.ndarray, borders: np.ndarray, cuts: bool) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Segments of texts with a space in front, and the first segment of each text; empty texts have none."""
    filled = np.diff(borders) > 0
    data = np.insert(data, borders[:-1][filled], 32)
    borders = borders + np.r_[0, np.cumsum(filled)]
    at = np.zeros(0, np.int64)
    if cuts and len(data) > 2:
        at = np.flatnonzero((data[1:-1] == 32) & _HEAD[data[2:]]) + 1
        at = at[_TAIL[data[at - 1]] | _LEAD[data[np.maximum(at - 2, 0)]]]
    at = np.unique(np.r_[at, borders])
    segments = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), max(0, len(at) - 1), [None, pa.py_buffer(at), pa.py_buffer(data)]
    )
    return segments, np.searchsorted(at, borders)


def _alone(segments: list[bytes], cuts: bool) -> np.ndarray:
    """Segments whose ends are not those of a cut: they could touch the tokens of a neighbour."""
    return np.array(
        [not (cuts and len(s) > 2 and _HEAD[s[1]] and (_TAIL[s[-1]] or _LEAD[s[-2]])) for s in segments], bool
    )


def _lists(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(borders, pa.int64()), pa.array(values))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and the place of each value among them."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(values) else np.zeros(0, bool)
    at = np.empty(len(values), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], at


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Exact sums between borders."""
    return np.diff(np.r_[0, np.cumsum(values.astype(np.int64))][borders])


def aligned_documents(
    docs: DataFrame,
    byte_model: str,
    piece_model: str,
    with_groups: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 6 << 20,
) -> DataFrame:
    """One row per row of ``docs``: token, group and link counts, and what the links count in the corpus.

    ``groups`` holds the ids of all groups as text (``a1,a2|b1;a3|b2``), ``groups_sha256``
    its checksum; ``n_best`` counts the links whose pair is the most frequent of its second
    id, ties included, ``count_sum`` adds up the counts of all links. A null or empty text,
    and one whose tokens don't spell it, has no tokens: zeros and empty strings. Very long
    texts are aligned segment by segment; repeated rows and ids are rows of their own, ids may
    be null or of any type, other columns are ignored, and an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    count = exchange.buckets(docs)
    texts = small_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, block = Models(byte_model, piece_model), TaskContext.get().partitionId() << 32
        for batch in shards(batches, "text", block_bytes):
            yield _asked(batch, models, block, count, with_groups)
            block += 1

    def total(table: pa.Table) -> pa.Table:
        parts = list(map(exchange.unpacked, table.column("packed")))
        pairs = [p.column("pair").to_numpy() for p in parts]
        own, at = _distinct(np.concatenate(pairs))
        totals = np.zeros(len(own), np.int64)
        np.add.at(totals, at, np.concatenate([p.column("n").to_numpy() for p in parts]))
        # the largest count per second id, for all blocks
        second = (own & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.lexsort((totals, second))
        last = order[np.r_[second[order][1:] != second[order][:-1], True]]
        top = exchange.packed({"id": pa.array(second[last]), "n": pa.array(totals[last])})
        cuts = np.cumsum([len(p) for p in pairs])[:-1]
        answers = [exchange.packed({"n": pa.array(totals[x])}) for x in np.split(at, cuts)]
        return pa.table(
            {
                "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()),
                "bucket": pa.array([*table.column("bucket").to_pylist(), 0], pa.int32()),
                "packed": pa.array([*answers, top], pa.binary()),
            }
        )

    asked = materialise(texts.mapInArrow(lean(ask), exchange.ASKED), "asked")
    answers = materialise(exchange.answered(asked, total), "totals")
    best = _largest(answers.where("block = -1"), piece_model)

    def finish(table: pa.Table) -> pa.Table:
        kept, parts = exchange.in_order(table)
        docs, segments, own = kept[-1], kept[-2], kept[-3].column("pair").to_numpy()
        totals = np.concatenate([np.zeros(0, np.int64), *[p.column("n").to_numpy() for p in parts]])
        is_best = totals == best[(own & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        pairs, borders = _flat(segments.column("pairs"))
        seg_count, seg_best = _sums(totals[pairs], borders), _sums(is_best[pairs], borders)
        codes, doc_borders = _flat(docs.column("codes"))
        times = docs.column("times").values.to_numpy(zero_copy_only=False).astype(np.int64)
        out = {c: docs.column(c) for c in docs.schema.names if c not in ("codes", "times")}
        out["n_best"] = pa.array(_sums(seg_best[codes] * times, doc_borders))
        out["count_sum"] = pa.array(_sums(seg_count[codes] * times, doc_borders))
        return pa.table(out)

    longs = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links"))
    schema = f"doc_id {kind}, {longs}, groups_sha256 string{', groups string' * with_groups}, n_best long, count_sum long"
    parts = asked.where("bucket < 0").unionByName(answers.where("block >= 0"))
    return exchange.finished(parts, finish, schema)


def _asked(
    batch: pa.RecordBatch, models: Models, block: int, buckets: int, with_groups: bool
) -> pa.RecordBatch:
    """Rows of one block: its documents, its segments, its pairs, and a question per bucket."""
    segments, first = _cut(*buffer(batch.column("text")), models.cuts)
    coded = segments.dictionary_encode()
    names = coded.dictionary.to_pylist()
    held = models.align(names, _alone(names, models.cuts))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not held.spelt.all():
        # the tokens of a text may spell it although those of its segments don't: whole texts decide
        wrong = np.r_[0, np.cumsum(~held.spelt[code])]
        bad = np.flatnonzero(wrong[first[1:]] > wrong[first[:-1]])
        whole = [b" " + batch.column("text")[int(i)].as_py().encode() for i in bad]
        parts = np.split(code, first[1:-1])
        for k, i in enumerate(bad):
            parts[i] = np.array([len(names) + k])
        held = held + models.align(whole, np.ones(len(whole), bool))
        code = np.concatenate(parts)
        first = np.r_[0, np.cumsum(list(map(len, parts)))]
    # pairs that only dropped segments have are asked about with a count of nothing
    used = np.bincount(code, minlength=len(held.n_a))
    own, at = _distinct(held.keys)
    times = np.bincount(at, np.repeat(used, held.n_links), len(own)).astype(np.int64)
    bucket = exchange.bucket_of(own, buckets)
    order = np.lexsort((own, bucket))
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    own, times, bucket = own[order], times[order], bucket[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    questions = [
        (int(bucket[a]), exchange.packed({"pair": pa.array(own[a:b]), "n": pa.array(times[a:b])}))
        for a, b in zip(starts, np.r_[starts[1:], len(own)], strict=True)
    ]
    texts = held.texts
    joined = [";".join([texts[c] for c in code[a:b].tolist()]) for a, b in zip(first[:-1], first[1:], strict=True)]
    # of each document its distinct segments and how often they stand there
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    cells, mult = np.unique(doc << 32 | code, return_counts=True)
    borders = np.searchsorted(cells >> 32, np.arange(len(first)))
    counts = ("n_a", "n_b", "n_groups", "n_links")
    columns = {
        "doc_id": batch.column("doc_id"),
        **{name: pa.array(_sums(getattr(held, name)[code], first)) for name in counts},
        "groups_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in joined], pa.string()),
        **({"groups": pa.array(joined, pa.string())} if with_groups else {}),
        "codes": _lists((cells & 0xFFFFFFFF).astype(np.uint32), borders),
        "times": _lists(mult.astype(np.uint32), borders),
    }
    kept = [
        (-1, exchange.packed(columns)),
        (-2, exchange.packed({"pairs": _lists(place[at].astype(np.uint32), np.r_[0, np.cumsum(held.n_links)])})),
        (-3, exchange.packed({"pair": pa.array(own, pa.uint64())})),
    ]
    return exchange.rows(block, kept + questions)


def _largest(tops: DataFrame, piece_model: str) -> np.ndarray:
    """The largest count of each id of the second model: an array of its vocabulary's size."""
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    size = -(-size // SLICES) * SLICES

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(size, np.int64)
        for batch in batches:
            for part in map(exchange.unpacked, batch.column("packed")):
                np.maximum.at(best, part.column("id").to_numpy(), part.column("n").to_numpy())
        yield slices(best)

    return merged(tops.mapInArrow(lean(reduce), SUMMARY), size, np.int64, np.maximum)


@query("op11_cross_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    models = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return aligned_documents(documents(spark, sf_dir), *models, with_groups=False)
