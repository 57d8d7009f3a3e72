"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its words. Lines that are the same but for case and white space are
one class, which the join sees once. Words are ordered by rarity, estimated by a table of
counts of fixed size (any one order keeps the join exact; a rarer start makes it cheaper).

Two sets with a Jaccard similarity of ``s`` share two words among their first
``n - ceil(s n) + 2``. If the rarest word they share is rare, it alone is their key; else
the two rarest are. Classes that share a key are candidates if their sizes and the places
of the key's first word, taken as the rarest they share, leave room for enough common words.
A map of each line's words rules out most false candidates before any text is fetched: a bit is
the parity of the words on it, so two maps differ in at most as many bits as words are in
one of the lines only, and a long line doesn't fill its map.

A line is removed when its class or a similar one has an earlier line, so one similar
earlier class is enough, and no group gives all of its pairs. A class is first compared
with the ``GIVEN`` earliest candidates of each of its groups, whatever their size. A class
that has more of them, and is similar to none of these, meets the rest of its groups'
earlier classes in a second step. Candidates are verified on their words, which are fetched
for candidate classes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickweave.llm import hashing
from tickweave.llm.blobs import BLOCKS, SUMMARY, Bloom, Dealer, Tally, merged, records, runs, slices
from tickweave.llm.exchange import buckets
from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, lean_group, materialise, partitions, shards, small_batches

CELLS = 1 << 21
#: A class with a key: its name, two halves of its map, size and place of the key's word, and its earliest line in order.
RECORD = np.dtype([(x, "<u8") for x in ("key", "line", "low", "high", "doc")] + [(x, "<u4") for x in ("n", "at", "row")])
BLOCK = 1 << 16
PAIR = np.dtype([("key", "<u8"), ("y", "<u8")])
GROUP = ("x", "key", "n", "at", "low", "high", "doc", "row")
SIGN = np.uint64(1 << 63)
#: Up to this many classes a key's group is searched as one block; the records of larger ones are rows.
SMALL = 1024
#: Of a larger group, so many of the earliest classes are searched in the first step.
HEADS = 64
#: Earliest candidates that a class meets in the first step, in each of its groups.
GIVEN = 2
#: A word in more lines than this is never rare, whatever the size of the corpus.
RARE = 512
MAP_WORDS = 4


def line_table(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, start and end of every line in document order, and the document of each."""
    raw, borders = hashing.buffer(column)
    breaks = np.flatnonzero(raw == 10)
    doc = np.searchsorted(borders, breaks, "right") - 1
    per = np.bincount(doc, minlength=len(column))
    owner = np.repeat(np.arange(len(column)), per + 1)
    starts, ends = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
    first = np.cumsum(per + 1) - (per + 1)
    is_first = np.zeros(len(owner), bool)
    is_first[first] = True
    is_last = np.zeros(len(owner), bool)
    is_last[first + per] = True
    starts[is_first], starts[~is_first] = borders[:-1], breaks + 1
    ends[is_last], ends[~is_last] = borders[1:], breaks
    return hashing.FOLD[raw], starts, ends, owner


def lines_and_words(column: pa.Array, least: int):
    """The line table, class of each line, and hash and line of every word.

    A class is the hash of a line's folded bytes; it is 0 for a line of fewer than ``least``
    words, which is left alone. Line breaks are white space, so no word crosses a line.
    """
    data, starts, ends, owner = line_table(column)
    sums = hashing.prefix_sums(data)
    word, line, _ = hashing.words(data, np.r_[starts, len(data)], sums)
    ids = np.maximum(hashing.span_hash(data, sums, starts, ends), np.uint64(1))
    ids[np.bincount(line, minlength=len(starts)) < least] = 0
    return data, starts, ends, owner, ids, word, line


def keys_of(word: np.ndarray, line: np.ndarray, n_lines: int, rank: np.ndarray, rare: int, num: int, den: int):
    """Key, line, set size and place of all keys of all lines, and the two halves of each line's map of words.

    The similarity is ``num / den``.
    """
    if n_lines > BLOCK:
        parts = []
        for a in range(0, n_lines, BLOCK):
            i, j = np.searchsorted(line, [a, a + BLOCK])
            key, own, *rest = keys_of(word[i:j], line[i:j] - a, min(BLOCK, n_lines - a), rank, rare, num, den)
            parts.append((key, own + a, *rest))
        return [np.concatenate(x) for x in zip(*parts, strict=True)]
    # 8 bits of rank and 40 of hash below the line's number: one sort of plain numbers, rare words first
    token = (rank[(word >> np.uint64(43)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24))
    both = np.sort((line.astype(np.uint64) << np.uint64(48)) | token)
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    line, token = (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)
    n = np.bincount(line, minlength=n_lines)
    first = np.cumsum(n) - n
    at = np.arange(len(token)) - first[line]
    size = n[line]
    maps, place = np.zeros((2, n_lines), np.uint64), hashing.mix(token) >> np.uint64(57)
    np.bitwise_xor.at(maps, ((place >> np.uint64(6)).astype(np.int64), line), np.uint64(1) << (place & np.uint64(63)))
    prefix = size - -(-num * size // den) + 2
    held = np.flatnonzero(at < prefix)
    is_rare = (token >> np.uint64(40)) <= rare
    single = held[is_rare[held] | (size[held] == 1)]
    out = [(hashing.mix(token[single]), line[single], size[single], at[single])]
    common = held[~is_rare[held]]
    gap = 1
    while len(common):
        other = common + gap
        ok = other < np.minimum(len(token), first[line[common]] + prefix[common])
        ok &= other < first[line[common]] + size[common]
        common, other = common[ok], other[ok]
        if len(common):
            key = hashing.mix(hashing.mix(token[common]) + token[other])
            out.append((key, line[common], size[common], at[common]))
        gap += 1
    return *[np.concatenate(x) for x in zip(*out, strict=True)], *maps


def few_differ(n, a, m, b, num: int, den: int):
    """Whether sets of sizes ``n`` and ``m`` can be similar by their maps: no more bits differ than words."""
    one = lambda x, y: F.bit_count(x.bitwiseXOR(y)) if isinstance(x, Column) else np.bitwise_count(x ^ y).astype(np.int64)
    count = sum(one(x, y) for x, y in zip(a, b, strict=True))
    return (num + den) * (n + m - count) >= 2 * num * (n + m)


def possible(n, at, m, bt, num: int, den: int):
    """Whether sets of sizes ``n`` and ``m`` can be similar if the words at ``at`` and ``bt`` are the rarest they share."""
    least = F.least if isinstance(n, Column) else np.minimum
    room = 1 + least(n - 1 - at, m - 1 - bt)
    return (den * least(n, m) >= num * (n + m - least(n, m))) & ((num + den) * room >= num * (n + m))


def by_place(r: np.ndarray) -> np.ndarray:
    """Records by key, and by the earliest line in a key's group; groups of one class are left out."""
    r = r[np.argsort(r["key"])]
    _, length = runs(r["key"])
    r = r[np.repeat(length, length) > 1]
    # several tasks may have sent a class: its earliest line counts
    r = r[np.lexsort((r["row"], r["doc"], r["line"], r["key"]))]
    if len(r):
        r = r[np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["line"][1:] != r["line"][:-1])]]
    _, length = runs(r["key"])
    r = r[np.repeat(length, length) > 1]
    return r[np.lexsort((r["row"], r["doc"], r["key"]))]


def candidates(r: np.ndarray, small: int, heads: int, given: int, num: int, den: int):
    """The ``given`` earliest candidates of every record ordered by place, and whether it may have more.

    Rows of the record and of the candidate, and a flag for every record. Of groups of more
    than ``small`` classes only the ``heads`` earliest are searched.
    """
    first, length = runs(r["key"])
    base, size = np.repeat(first, length), np.repeat(length, length)
    pos = np.arange(len(r)) - base
    low, high, n, at = (np.ascontiguousarray(r["low"]), np.ascontiguousarray(r["high"]), r["n"].astype(np.int64), r["at"].astype(np.int64))
    # the last member that a record is compared with
    last = np.where(size > small, np.minimum(pos, heads), pos)
    found = np.zeros(len(r), np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, k = np.flatnonzero(last > 0), 0
    while len(i):
        j = base[i] + k
        ok = few_differ(n[i], [low[i]], n[j], [low[j]], num, den)
        a, b = i[ok], j[ok]
        ok = few_differ(n[a], [low[a], high[a]], n[b], [low[b], high[b]], num, den)
        ok &= possible(n[a], at[a], n[b], at[b], num, den)
        a, b = a[ok], b[ok]
        found[a] += 1
        new = found[a] <= given
        left.append(a[new])
        right.append(b[new])
        k += 1
        i = i[(last[i] > k) & (found[i] <= given)]
    return np.concatenate(left), np.concatenate(right), (found > given) | (last < pos)


def earlier_partners(r: np.ndarray, wanted: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All candidates before each of the ``wanted`` classes in one group ordered by place."""
    maps, n, at = (r["low"], r["high"]), r["n"].astype(np.int64), r["at"].astype(np.int64)
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i in np.flatnonzero(np.isin(r["line"], wanted)):
        ok = few_differ(n[:i], [x[:i] for x in maps], n[i], [x[i] for x in maps], num, den)
        ok &= possible(n[:i], at[:i], n[i], at[i], num, den)
        right.append(r["line"][:i][ok])
        left.append(np.full(len(right[-1]), r["line"][i]))
    return np.concatenate(left), np.concatenate(right)


def distinct_pairs(r: np.ndarray) -> np.ndarray:
    r = r[np.lexsort((r["y"], r["key"]))]
    return r[np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["y"][1:] != r["y"][:-1])]] if len(r) else r


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def places(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return hashing.mix(hashing.mix(doc.astype(np.int64).view(np.uint64)) + line.astype(np.uint64)).view(np.int64)


def order_of(doc: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for every line that order lines by id and place, null ids first."""
    null = np.asarray(doc.is_null().to_numpy(zero_copy_only=False))
    number = pa.compute.fill_null(doc, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ SIGN
    number = np.where(null, np.uint64(0), number)
    row = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(doc)), "left")[owner]
    # the highest bit puts a null before the least id
    return number[owner], (row + np.where(null, 0, 1 << 31)[owner]).astype(np.uint32)


def word_maps(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct words of each folded line, and a map of them of ``64 * MAP_WORDS`` bits."""
    maps, size = np.zeros((len(texts), MAP_WORDS), np.uint64), np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    word, line, _ = hashing.words(data, np.r_[0, np.cumsum(size)])
    order = np.lexsort((word, line))
    word, line = word[order], line[order]
    if len(word):
        new = np.r_[True, (word[1:] != word[:-1]) | (line[1:] != line[:-1])]
        word, line = word[new], line[new]
        place = hashing.mix(word) >> np.uint64(56)
        bit = np.uint64(1) << (place & np.uint64(63))
        np.bitwise_xor.at(maps, (line, (place >> np.uint64(6)).astype(np.int64)), bit)
    return np.bincount(line, minlength=len(texts)), maps.view(np.int64)


def _similar(a: str, b: str, num: int, den: int) -> bool:
    x, y = set(a.split(" ")) - {""}, set(b.split(" ")) - {""}
    common = len(x & y)
    return den * common >= num * (len(x) + len(y) - common)


class _Join:
    """The steps of one run over one table of documents."""

    def __init__(self, docs: DataFrame, least: int, num: int, den: int):
        self.docs, self.least, self.num, self.den = docs, least, num, den
        self.spark = docs.sparkSession

    def scan(self) -> tuple[DataFrame, np.ndarray]:
        """Class ids of the lines of every document, and the rank of every cell of words."""
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = Tally(CELLS)
            for batch in shards(batches, "text"):
                _, _, _, owner, ids, word, _ = lines_and_words(batch.column("text"), least)
                count.add(word >> np.uint64(43))
                cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                own = [ids[a:b].view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("th"),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(own) if n else [], pa.int64())),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    ["doc_id", "th", "ids", "slice", "part"],
                )
            part = slices(count.counts())
            n = part.num_rows
            nothing = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*nothing, *part.columns], ["doc_id", "th", "ids", "slice", "part"])

        table = materialise(self.docs.mapInArrow(lean(run), f"doc_id long, th long, ids array<long>, {SUMMARY}"), "lines")
        count = merged(table.where(F.col("slice").isNotNull()), CELLS, np.uint32, np.add)
        rank = np.minimum(255, 8 * np.log2(1.0 + count)).astype(np.uint8)
        self.rare = int(min(255, 8 * np.log2(1.0 + np.clip(8.0 * count.mean(), 32.0, RARE))))
        return table.where(F.col("slice").isNull()).select("doc_id", "th", "ids"), rank

    def groups(self, rank: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """What every class meets first, and the groups of classes that may have more candidates.

        Distinct pairs ``x, y`` with ``y`` earlier, or ``y = x`` for a class ``x`` that may have more; and the
        groups: ``key, block`` for a small one, the columns ``GROUP`` for each class of a large one.
        """
        least, num, den, rare = self.least, self.num, self.den, self.rare
        count = max(2 * partitions(self.spark), buckets(self.docs))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dealer, seen = Dealer(count), np.zeros(0, RECORD)
            for batch in shards(batches, "text"):
                _, _, _, owner, ids, word, line = lines_and_words(batch.column("text"), least)
                doc, row = order_of(batch.column("doc_id"), owner)
                used = np.flatnonzero(ids)
                used = used[np.lexsort((row[used], doc[used], ids[used]))]
                used = used[np.r_[True, ids[used[1:]] != ids[used[:-1]]]] if len(used) else used
                # a class once per task, and again when an earlier line of it comes
                at = np.searchsorted(seen["line"], ids[used])
                old = np.append(seen, np.zeros(1, RECORD))[at]
                known = (at < len(seen)) & (old["line"] == ids[used])
                used = used[~known | (doc[used] < old["doc"]) | ((doc[used] == old["doc"]) & (row[used] < old["row"]))]
                mine = np.zeros(len(used), RECORD)
                mine["line"], mine["doc"], mine["row"] = ids[used], doc[used], row[used]
                seen = seen[~np.isin(seen["line"], mine["line"], assume_unique=True)]
                seen = np.concatenate([seen, mine])
                seen = seen[np.argsort(seen["line"])]
                keep = np.zeros(len(ids), bool)
                keep[used] = True
                used = keep[line]
                key, own, n, at, low, high = keys_of(word[used], line[used], len(ids), rank, rare, num, den)
                out = np.empty(len(key), RECORD)
                out["key"], out["line"], out["n"], out["at"] = key, ids[own], n, at
                out["low"], out["high"], out["doc"], out["row"] = low[own], high[own], doc[own], row[own]
                yield from dealer.add(out)
            yield from dealer.rest()

        def meet(table: pa.Table) -> pa.Table:
            r = by_place(records(table, RECORD))
            a, b, more = candidates(r, SMALL, HEADS, GIVEN, num, den)
            out = np.empty(len(a) + np.count_nonzero(more), PAIR)
            out["key"] = np.r_[r["line"][a], r["line"][more]]
            out["y"] = np.r_[r["line"][b], r["line"][more]]
            dealer = Dealer(count)
            blocks = [*dealer.add(distinct_pairs(out)), *dealer.rest()]
            first, length = runs(r["key"])
            stay = np.logical_or.reduceat(more, first) if len(first) else np.zeros(0, bool)
            large = r[np.repeat(stay & (length > SMALL), length)]
            small = np.flatnonzero(stay & (length <= SMALL))
            groups = [r[first[g] : first[g] + length[g]].tobytes() for g in small]
            columns = {"x": "line", "key": "key", "n": "n", "at": "at", "low": "low", "high": "high", "row": "row"}
            rows = {k: signed(large[f]) for k, f in columns.items()} | {"doc": signed(large["doc"] ^ SIGN)}
            parts = [pa.table(rows), pa.table({"key": signed(r["key"][first[small]]), "block": pa.array(groups, pa.binary())})]
            none = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), *[(k, pa.int64()) for k in GROUP]])
            parts += [pa.Table.from_batches([b]) for b in blocks]
            return pa.concat_tables([none.empty_table(), *parts], promote_options="default")

        def once(table: pa.Table) -> pa.Table:
            r = distinct_pairs(records(table, PAIR))
            return pa.table({"x": signed(r["key"]), "y": signed(r["y"])})

        dealt = self.docs.mapInArrow(lean(run), BLOCKS).groupBy("bucket")
        schema = f"bucket int, block binary, {', '.join(f'{k} long' for k in GROUP)}"
        found = materialise(dealt.applyInArrow(lean_group(meet), schema), "line-groups")
        # a pair shares several keys and so comes from several buckets
        met = found.where(F.col("bucket").isNotNull()).select("bucket", "block").groupBy("bucket")
        met = met.applyInArrow(lean_group(once), "x long, y long")
        return materialise(met, "met-lines"), found.where(F.col("bucket").isNull()).drop("bucket")

    def others(self, open_: DataFrame, groups: DataFrame) -> DataFrame:
        """Distinct pairs ``x, y`` of the open classes ``x`` and all their earlier candidates in ``groups``."""
        num, den = self.num, self.den
        small = groups.where(F.col("block").isNotNull()).select("key", "block")

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, block in zip(batch.column("key"), batch.column("block"), strict=True):
                    line = np.frombuffer(block.as_buffer(), RECORD)["line"]
                    keys = pa.array(np.full(len(line), key.as_py()), pa.int64())
                    yield pa.RecordBatch.from_arrays([signed(line), keys], ["x", "key"])

        def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, asked in zip(batch.column("block"), batch.column("asked"), strict=True):
                    wanted = np.array(asked.as_py(), np.int64).view(np.uint64)
                    x, y = earlier_partners(np.frombuffer(block.as_buffer(), RECORD), wanted, num, den)
                    yield pa.RecordBatch.from_arrays([signed(x), signed(y)], ["x", "y"])

        # a small group has at most SMALL classes
        asked = small.mapInArrow(lean(members), "x long, key long").join(open_, "x")
        asked = asked.groupBy("key").agg(F.collect_list("x").alias("asked"))
        inside = small.join(asked, "key").select("block", "asked").mapInArrow(lean(partners), "x long, y long")
        large = groups.where(F.col("block").isNull()).drop("block")
        mine = large.join(open_, "x").select("key", *[F.col(c).alias(f"my_{c}") for c in GROUP if c != "key"])
        maps, mine_ = [F.col("low"), F.col("high")], [F.col("my_low"), F.col("my_high")]
        fits = few_differ(F.col("my_n"), mine_, F.col("n"), maps, num, den)
        fits &= possible(*[F.col(c) for c in ("my_n", "my_at", "n", "at")], num, den)
        earlier = F.struct("doc", "row") < F.struct(F.col("my_doc").alias("doc"), F.col("my_row").alias("row"))
        rows = mine.join(large, "key").where(earlier & fits).select(F.col("my_x").alias("x"), F.col("x").alias("y"))
        return inside.unionByName(rows).distinct()

    def facts(self, met: DataFrame, first: DataFrame) -> DataFrame:
        """``x, text, n, map, first`` of all classes in pairs, found in the documents by a filter of fixed size."""
        every = met.select("x").unionByName(met.select(F.col("y").alias("x")))
        needed = materialise(first.join(every.distinct(), "x"), "needed-lines")

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc = pa.compute.fill_null(batch.column(0), -1).to_numpy(zero_copy_only=False)
                place = places(doc, batch.column(1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(place)], ["place"])

        # a class is read where its first line stands
        wanted = Bloom.of(needed.select("first.doc_id", "first.line").mapInArrow(lean(hashed), "place long"))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in shards(batches, "text"):
                data, starts, ends, owner = line_table(batch.column("text"))
                doc = pa.compute.fill_null(batch.column("doc_id"), -1).to_numpy(zero_copy_only=False)
                line = np.arange(len(owner)) - np.searchsorted(owner, np.arange(batch.num_rows), "left")[owner]
                rows = np.flatnonzero(wanted.find(places(doc[owner], line)))
                raw = data.tobytes()
                text = [raw[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
                size = np.array([len(x) for x in text], np.int64)
                joined = np.frombuffer(b"".join(text), np.uint8)
                edge = np.r_[0, np.cumsum(size)]
                name = hashing.span_hash(joined, hashing.prefix_sums(joined), edge[:-1], edge[1:])
                ids = np.maximum(name, np.uint64(1))
                n, maps = word_maps(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids.view(np.int64)),
                        pa.array([x.decode() for x in text], pa.string()),
                        pa.array(n, pa.int64()),
                        pa.FixedSizeListArray.from_arrays(pa.array(maps.ravel()), MAP_WORDS).cast(pa.list_(pa.int64())),
                    ],
                    ["x", "text", "n", "map"],
                )

        found = self.docs.mapInArrow(lean(fetch), "x long, text string, n long, map array<long>")
        one = found.groupBy("x").agg(*[F.first(c).alias(c) for c in ("text", "n", "map")])
        return materialise(one.join(needed, "x"), "line-facts")

    def verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The classes ``x`` of pairs ``x, y`` that are similar to one of their ``y``."""
        num, den = self.num, self.den

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = zip(batch["text"].to_pylist(), batch["other"].to_pylist(), strict=True)
                yield batch.filter(pa.array([_similar(a, b, num, den) for a, b in both], pa.bool_())).select(["x"])

        other = texts.select(F.col("x").alias("y"), F.col("text").alias("other"))
        both = pairs.join(texts, "x").join(other, "y").select("x", "text", "other")
        return materialise(both.mapInArrow(lean(check), "x long").distinct(), "late-lines")

    def ordered(self, pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """Pairs that finer maps of their words leave possible: ``x``, the earlier class ``y`` and its first line."""
        one = facts.select("x", "n", "map", "first")
        two = facts.select(F.col("x").alias("y"), *[F.col(c).alias(f"y_{c}") for c in ("n", "map", "first")])
        both = pairs.join(one, "x").join(two, "y").where(F.col("first") != F.col("y_first"))
        differ = F.lit(0)
        for i in range(MAP_WORDS):
            differ = differ + F.bit_count(F.col("map")[i].bitwiseXOR(F.col("y_map")[i]))
        n = F.col("n") + F.col("y_n")
        both = both.where((self.num + self.den) * (n - differ) >= 2 * self.num * n)
        swap = F.col("first") < F.col("y_first")
        return both.select(
            F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"),
            F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"),
            F.least("first", "y_first").alias("other"),
        )

    def settled(self, met: DataFrame, first: DataFrame) -> DataFrame:
        """The classes of the pairs ``met`` that are the later of two similar ones."""
        facts = self.facts(met, first)
        return self.verify(self.ordered(met, facts).select("x", "y"), facts.select("x", "text"))

    def late(self, rank: np.ndarray, first: DataFrame) -> DataFrame:
        """Classes with a similar class that has an earlier line."""
        met, groups = self.groups(rank)
        late = self.settled(met.where("x <> y"), first)
        more = met.where("x = y").select("x")
        open_ = materialise(more.join(late, "x", "left_anti"), "open-lines")
        if open_.isEmpty():
            return late
        rest = materialise(self.others(open_, groups), "rest-lines")
        return late.unionByName(self.settled(rest, first)).distinct()


def removed_lines(
    docs: DataFrame, least: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, th, removed`` for documents with removed lines; ``th`` is the hash of the text, lines count from 0."""
    slim = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.xxhash64(docs[text_col].cast("string")).alias("th"),
        docs[text_col].cast("string").alias("text"),
    )
    join = _Join(small_batches(slim), least, num, den)
    table, rank = join.scan()
    each = table.select("doc_id", "th", F.posexplode("ids").alias("line", "x")).where(F.col("x") != 0)
    place = F.struct("doc_id", "line")
    first = materialise(each.groupBy("x").agg(F.min(place).alias("first"), F.count("*").alias("times")), "line-classes")
    late = join.late(rank, first.select("x", "first"))
    facts = first.join(late.withColumn("late", F.lit(True)), "x", "left").where("times > 1 or late is not null")
    gone = each.join(facts, "x").where(F.col("late").isNotNull() | (place > F.col("first")))
    return materialise(gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("removed")), "removed-lines")


def dedup_lines(
    docs: DataFrame,
    least: int = 5,
    num: int = 4,
    den: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with removed lines taken out of the text, and columns ``counts``: its lines, and those removed.

    A line is a run between line feeds; its set is its distinct words, A to Z lower-cased.
    It goes when a line at an earlier place (id, then line) has a similarity of at least
    ``num / den``, kept or not. A line of fewer than ``least`` words always stays. Null ids
    come first. Rows that repeat an id count as one place, so their lines don't remove each
    other. A null text stays null and has no lines. Columns of ``docs`` with the
    names of ``counts`` are replaced. No document goes, even when no line of it is left.
    """
    gone = removed_lines(docs, least, num, den, id_col, text_col)
    rest = docs.drop(*counts)
    # a name that no column of the input has
    tag = next(f"_r{i}" for i in range(len(rest.columns) + 1) if all(f"_r{i}" not in c for c in rest.columns))
    g = gone.select(F.col("doc_id").alias(f"{tag}d"), F.col("th").alias(f"{tag}h"), F.col("removed").alias(f"{tag}l"))
    # only documents that may lose lines are shuffled; the filter has a fixed size
    touched, names = Bloom.of(gone.select("th")), rest.columns
    marked = small_batches(rest.withColumn(f"{tag}t", F.xxhash64(rest[text_col].cast("string"))))

    def part(inside: bool):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = touched.find(batch.column(f"{tag}t").to_numpy(zero_copy_only=False)) == inside
                yield batch.filter(pa.array(hit)).select(names)

        return choose

    dirty = marked.mapInArrow(lean(part(True)), rest.schema)
    same = dirty[id_col].cast("long").eqNullSafe(g[f"{tag}d"]) & (F.xxhash64(dirty[text_col].cast("string")) == g[f"{tag}h"])
    dirty = small_batches(dirty.join(g, same, "left").select(*[dirty[c] for c in rest.columns], f"{tag}l"))
    schema = StructType(list(rest.schema.fields)).add(counts[0], "long").add(counts[1], "long")

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            lost = batch.column(f"{tag}l").to_pylist() if f"{tag}l" in batch.schema.names else [None] * len(texts)
            out, n, m = [], [], []
            for text, away in zip(texts, lost, strict=True):
                parts = text.split("\n") if text is not None else []
                n.append(len(parts))
                m.append(len(away or ()))
                if away:
                    out_of = set(away)
                    text = "\n".join(x for i, x in enumerate(parts) if i not in out_of)
                out.append(text)
            columns = [pa.array(out, pa.string()) if x == text_col else batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n, pa.int64()), pa.array(m, pa.int64())], [*names, *counts]
            )

    clean = part(False)
    untouched = marked.mapInArrow(lean(lambda batches: without(clean(batches))), schema)
    return untouched.unionByName(dirty.mapInArrow(lean(without), schema))


@query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every line with a word takes part
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), least=1)
    return out.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
