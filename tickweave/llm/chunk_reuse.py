"""BPE encoding and decoding with chunks that documents share encoded once.

A text is cut where a rolling hash of the bytes before a place says so, so equal passages
give equal chunks wherever they stand. A block of documents asks for each of its distinct
chunks once (``exchange``); the chunk's owner gets it from all blocks, encodes it once, and
answers with its ids and what is needed to join it.

The ids of two neighbours don't simply follow each other, as a cut may go through a word.
A join is repaired by encoding a window again, from a border in the left chunk to a place in
the right one, until a border of the window agrees with a border of the right chunk. White
space after another character is such a border for every window, so mostly the window is the
text between the last such space of the left chunk and the first of the right one. Where a
chunk has none, more and more of the right chunk is taken, then the next chunk, as long as
no border agrees. The ids are those of the left chunk up to the window, of the window up to
the agreed border and of the right chunk from there.

Why this is exact: the tokenizer first normalises a text, then splits it into words by a
pattern that reads on from the end of the last word, at most ``LOOK`` characters ahead, and
merges inside words only. Tokens that end a word are marked. So from a place where a word
ends, the rest of a text is encoded the same whatever stands before it, as long as the
normalisation doesn't join the characters on both sides (``_joins``); and what a chunk
encodes up to such a place is that of the whole text if ``LOOK`` more characters follow in
the chunk. Special tokens are found before all this; no cut goes through one.
"""

from __future__ import annotations

import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import exchange
from tickweave.llm.hashing import U64, buffer, prefix_sums, raw_hashes
from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, shards, small_batches
from tickweave.llm.vocabulary import WordIds

#: Bytes that decide about a cut, the least length of a chunk, and the mean length above it.
ROLL, LEAST, MEAN = 32, 256, 1024
#: Characters after a word that decide where it ends, and the first size of a window in a chunk without spaces.
LOOK, WINDOW = 4, 48
#: Chunks that are encoded in one step.
STEP = 4096


@cache
def _joins() -> frozenset[str]:
    """Characters that normalisation may join with the one before: combining ones and second parts of pairs."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        parts = unicodedata.decomposition(x).split()
        if unicodedata.combining(x):
            out.add(x)
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


class Coder:
    """Ids of texts by a tokenizer whose tokens mark the ends of words, and where these ends are."""

    def __init__(self, path: str, end: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(names.values()) + 1
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = [t.content for t in added.values()]
        self.names = [""] * size
        self.ends = np.zeros(size, bool)
        for name, i in names.items():
            self.names[i], self.ends[i] = name, name.endswith(end) or i in added
        self.joins = _joins()
        #: the narrowest type that holds all ids, for what is shuffled
        self.narrow = np.uint16 if size <= 1 << 16 else np.uint32

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of each text, and the places and numbers of tokens before every end of a word."""
        for i in range(0, len(texts), 256):
            for e in self.tokenizer.encode_batch(texts[i : i + 256], add_special_tokens=False):
                ids = np.array(e.ids, np.uint32)
                at = np.flatnonzero(self.ends[ids])
                offsets = e.offsets
                yield ids, np.array([offsets[k][1] for k in at.tolist()], np.int64), at + 1

    def borders(self, text: str, place: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those ends of words from which the rest of ``text`` stands for itself; they may still lie too near its end."""
        keep = [p < len(text) and text[p] not in self.joins for p in place.tolist()]
        return place[keep], number[keep]

    def decode(self, ids: np.ndarray) -> str:
        """The names of the tokens with spaces between, as the tokenizer has no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids.tolist()])


def cut_places(
    data: np.ndarray, borders: np.ndarray, specials: list[str], least: int = LEAST, mean: int = MEAN
) -> np.ndarray:
    """Places that content alone decides, and the borders of the documents."""
    found = np.zeros(0, np.int64)
    if len(data) > ROLL:
        roll = raw_hashes(prefix_sums(data), ROLL)
        found = np.flatnonzero((roll >> U64(40)) % U64(mean) == 0) + ROLL
    # a cut never lies inside a character or a special token
    inside = (data[np.minimum(found, len(data) - 1)] & 0xC0) == 0x80 if len(data) else np.zeros(0, bool)
    while inside.any():
        found = found + inside
        inside = (found < len(data)) & ((data[np.minimum(found, len(data) - 1)] & 0xC0) == 0x80)
    text = data.tobytes()
    for name in map(str.encode, specials):
        at = text.find(name)
        while at >= 0:
            found = found[(found <= at) | (found >= at + len(name))]
            at = text.find(name, at + 1)
    # cuts that follow the last one too closely are left out, from the start of each document
    kept, ends, k = [], borders.tolist(), 0
    last = 0
    for x in found.tolist():
        while k < len(ends) and ends[k] <= x:
            last = ends[k]
            k += 1
        if x - last >= least:
            kept.append(x)
            last = x
    return np.unique(np.r_[np.array(kept, np.int64), borders])


def _chunks(
    texts: pa.Array, specials: list[str], least: int = LEAST, mean: int = MEAN
) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Chunks of all texts by their distinct values, the first chunk of each text, and a hash of each distinct one."""
    data, borders = buffer(texts)
    at = cut_places(data, borders, specials, least, mean)
    # empty texts have no chunk
    first = np.searchsorted(at, borders)
    chunks = pa.LargeStringArray.from_buffers(max(0, len(at) - 1), pa.py_buffer(at), pa.py_buffer(data))
    coded = chunks.dictionary_encode()
    distinct, edges = buffer(coded.dictionary)
    view, edges = memoryview(distinct), edges.tolist()
    names = (xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True))
    hashes = np.fromiter(names, U64, len(coded.dictionary))
    return coded, first, hashes


def spaces(chunk: str) -> tuple[int, int] | None:
    """The first and the last place of a space after a character that is not white space."""
    first, last = chunk.find(" ", 1), chunk.rfind(" ", 1)
    while first > 0 and chunk[first - 1].isspace():
        first = chunk.find(" ", first + 1)
    while last > 0 and chunk[last - 1].isspace():
        last = chunk.rfind(" ", 1, last)
    return (first, last) if first > 0 else None


class Joiner:
    """The ids of documents from their chunks' answers, their joins repaired."""

    def __init__(self, coder: Coder, answers: list[dict], documents: list[list[int]]):
        self.coder, self.answers, self.known = coder, answers, {}
        pairs = {(a, b) for code in documents for a, b in zip(code[:-1], code[1:], strict=True)}
        both = [(answers[a]["tail"], answers[b]["text"]) for a, b in pairs if answers[a]["closed"] and answers[b]["closed"]]
        texts = list({a + b for a, b in both})
        self.windows = dict(zip(texts, (ids for ids, _, _ in coder.encode(texts)), strict=True))

    def ids(self, code: list[int]) -> np.ndarray:
        if not code:
            return np.zeros(0, np.uint32)
        parts, k, start = [], 0, 0  # chunk, and the token of it from which on its ids hold
        while True:
            chunk = self.answers[code[k]]
            if k + 1 == len(code):
                parts.append(chunk["ids"][start:])
                return np.concatenate(parts)
            left, window, at, right = self._join(code, k, start)
            parts += [chunk["ids"][start:left], window]
            if at is None:
                return np.concatenate(parts)
            k, start = at, right

    def _join(self, code: list[int], k: int, start: int) -> tuple[int, np.ndarray, int | None, int]:
        """Tokens of chunk ``k`` before the window, the window's ids, the chunk it agrees with and the token there."""
        chunk, right = self.answers[code[k]], self.answers[code[k + 1]]
        if chunk["closed"] and right["closed"]:
            window = self.windows[chunk["tail"] + right["text"]]
            return len(chunk["ids"]) - chunk["after"], window, k + 1, right["before"]
        key = (code[k], code[k + 1], start, k + 2 == len(code))
        if key in self.known:
            left, window, token = self.known[key]
            return left, window, k + 1, token
        left, text = self._tail(chunk, start)
        at, skip, wait = k + 1, 0, 1
        while at < len(code):
            right, last = self.answers[code[at]], at + 1 == len(code)
            if right["closed"]:
                window = next(self.coder.encode([text + right["text"]]))[0]
                return left, window, at, right["before"]
            whole, size = right["text"], WINDOW
            if skip and not last:
                # after a failure the window doubles, so that a word of many chunks isn't encoded once per chunk
                text, at, skip = text + whole, at + 1, skip - 1
                continue
            while True:
                size = min(size, len(whole))
                end = last and size == len(whole)
                found = self._agreed(text, whole[:size], right, end)
                if found is not None:
                    window, token = found
                    if token is None:
                        return left, window, None, 0
                    if at == k + 1:
                        self.known[key] = left, window, token
                    return left, window, at, token
                if size == len(whole):
                    break
                size *= 4
            text, at, skip, wait = text + whole, at + 1, wait, 2 * wait
        raise AssertionError("the last window of a document ends with it")

    def _tail(self, chunk: dict, start: int) -> tuple[int, str]:
        """The last border of a chunk that is sure, as a number of tokens, and the text after it."""
        if chunk["closed"]:
            return len(chunk["ids"]) - chunk["after"], chunk["tail"]
        place, number, text = chunk["place"], chunk["number"], chunk["text"]
        at = np.flatnonzero((place <= len(text) - LOOK) & (number >= start))
        if len(at):
            return int(number[at[-1]]), text[int(place[at[-1]]) :]
        return start, text[int(place[np.flatnonzero(number == start)[0]]) :] if start else text

    def _agreed(self, left: str, head: str, right: dict, end: bool) -> tuple[np.ndarray, int | None] | None:
        """Ids of the window up to the first border it shares with the right chunk, and the chunk's tokens before it."""
        ids, place, number = next(self.coder.encode([left + head]))
        shared = np.isin(place - len(left), right["place"]) & (place > len(left))
        if not end:
            shared &= place <= len(left) + len(head) - LOOK
        at = np.flatnonzero(shared)
        if len(at):
            x = int(place[at[0]]) - len(left)
            token = int(right["number"][np.flatnonzero(right["place"] == x)[-1]])
            return ids[: int(number[at[0]])], token
        # nothing follows, so the window ends with the document
        return (ids, None) if end else None


def _answers_of(coder: Coder, encode: WordIds, names: list[str]) -> dict[str, pa.Array]:
    """Of every chunk its ids and what joins it.

    With a space: the texts before its first and from its last one on, and the counts of their
    tokens. Without: its whole text, its borders, and the counts of tokens before them.
    """
    ids, ends = _words(encode, names)
    cut = [spaces(s) for s in names]
    closed = np.array([c is not None for c in cut], bool)
    text = [s if c is None else s[: c[0]] for s, c in zip(names, cut, strict=True)]
    tail = ["" if c is None else s[c[1] :] for s, c in zip(names, cut, strict=True)]
    before, after = (
        np.where(closed, np.diff(_words(encode, ["" if c is None else t for t, c in zip(part, cut, strict=True)])[1]), 0)
        for part in (text, tail)
    )
    open_ = [s for s, c in zip(names, cut, strict=True) if c is None]
    found = (coder.borders(s, place, number) for s, (_, place, number) in zip(open_, coder.encode(open_), strict=True))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    borders = [none if c else next(found) for c in closed]
    at = np.r_[0, np.cumsum([len(p) for p, _ in borders])].astype(np.int64)
    return {
        "ids": pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids.astype(coder.narrow))),
        "closed": pa.array(closed),
        "text": pa.array(text, pa.large_string()),
        "tail": pa.array(tail, pa.large_string()),
        "before": pa.array(before, pa.int64()),
        "after": pa.array(after, pa.int64()),
        "place": pa.LargeListArray.from_arrays(pa.array(at), pa.array(np.concatenate([none[0], *[p for p, _ in borders]]))),
        "number": pa.LargeListArray.from_arrays(pa.array(at), pa.array(np.concatenate([none[0], *[n for _, n in borders]]))),
    }


def _words(encode: WordIds, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and their borders, a step at a time."""
    ids, ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for i in range(0, len(texts), STEP):
        part, at = encode(pa.array(texts[i : i + STEP], pa.large_string()))
        ids.append(part)
        ends.append(at[1:] + ends[-1][-1])
    return np.concatenate(ids), np.concatenate(ends)


def encode(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 6 << 20,
    least: int = LEAST,
    mean: int = MEAN,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids, decoded``.

    ``ids`` are little-endian unsigned 32-bit numbers, those the tokenizer gives for the
    whole text without added special tokens; ``decoded`` is what it makes of them again,
    special tokens kept. A null or empty text has no tokens. Very long texts are cut and
    joined like others; repeated rows and ids are rows of their own, ids may be null or of
    any type, other columns are ignored, and an empty table gives no rows. The tokenizer must
    mark the tokens that end a word, split words by a pattern without a look back and
    have no decoder, as the one the query names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    count = exchange.buckets(docs)
    texts = small_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials, block = Coder(tokenizer).specials, TaskContext.get().partitionId() << 32
        for batch in shards(batches, "text", block_bytes):
            coded, first, hashes = _chunks(batch.column("text"), specials, least, mean)
            bucket = exchange.bucket_of(hashes, count)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code = coded.indices.to_numpy(zero_copy_only=False)
            lists = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(place[code], pa.int64()))
            parts = [(-1, exchange.packed({"doc_id": batch.column("doc_id"), "chunks": lists}))]
            starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, np.int64)
            for a, b in zip(starts, np.r_[starts[1:], len(order)], strict=True):
                own = coded.dictionary.take(pa.array(order[a:b]))
                parts.append((int(bucket[order[a]]), exchange.packed({"chunk": own})))
            yield exchange.rows(block, parts)
            block += 1

    def answer(table: pa.Table) -> pa.Table:
        asked = [exchange.unpacked(v).column("chunk") for v in table.column("packed")]
        coded = pa.chunked_array(asked, pa.large_string()).combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        own = _answers_of(Coder(tokenizer), WordIds(tokenizer), coded.dictionary.to_pylist())
        known = pa.RecordBatch.from_arrays(list(own.values()), list(own))
        out, start = [], 0
        for part in asked:
            rows = known.take(pa.array(code[start : start + len(part)]))
            out.append(exchange.packed(dict(zip(rows.schema.names, rows.columns, strict=True))))
            start += len(part)
        return table.set_column(2, "packed", pa.array(out, pa.binary()))

    def finish(table: pa.Table) -> pa.Table:
        kept, parts = exchange.in_order(table)
        docs = kept[-1]
        chunks = docs.column("chunks").to_pylist()
        joiner = Joiner(coder := Coder(tokenizer), [x for part in parts for x in _answers(part)], chunks)
        ids = [joiner.ids(x) for x in chunks]
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_tokens": pa.array(map(len, ids), pa.int64()),
                "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                "decoded": pa.array([coder.decode(x) for x in ids], pa.string()),
            }
        )

    asked = texts.mapInArrow(lean(ask), exchange.ASKED)
    schema = f"doc_id {kind}, n_tokens long, ids binary, decoded string"
    return exchange.finished(exchange.through(asked, answer, count), finish, schema)


def _answers(part: pa.RecordBatch) -> list[dict]:
    columns = {}
    for name in part.schema.names:
        column = part.column(name)
        if pa.types.is_large_list(column.type):
            values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            columns[name] = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        else:
            columns[name] = column.to_pylist()
    return [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)]


@query("op13_bpe_chunk_reuse")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
