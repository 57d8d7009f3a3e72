"""Near-duplicate documents: an n-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of five-word shingles; equal sets are one class. Shingles have one
order, rare ones first, by a table of counts of fixed size. Sets with a similarity of at
least ``s`` share ``l`` shingles among their first ``n - ceil(s n) + l``, for every ``l``.
Each class picks the ``l`` with the least estimated cost: the lists that its prefix meets,
the shingles that it sends, and the candidates to verify, of which there are at most
``lists / l``. A pair must share as many shingles as the smaller ``l`` of the two asks for.

Small lists give their candidate pairs at once. In a large list every class is paired with
one head; after components of what was verified, only classes outside the head's component
meet the other components of its lists. Links inside a component can't change the result.
Before any text is fetched, bit maps of the sets bound how similar two candidates can be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import hashing
from tickweave.llm.blobs import BLOCKS, SUMMARY, Bloom, Dealer, Tally, merged, records, runs, slices
from tickweave.llm.components import components
from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, lean_group, materialise, partitions, shards, small_batches

CELLS = 1 << 21
RECORD = np.dtype([("key", "<u8"), ("x", "<u8"), ("n", "<u4"), ("at", "<u4"), ("need", "<u4")])
SMALL = 32
SHINGLE = 5


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every text; none for a text without words."""
    data, borders = hashing.buffer(column)
    word, doc, _ = hashing.words(hashing.FOLD[data], borders)
    value, owner = hashing.shingles(word, doc, len(column), SHINGLE)
    cuts = np.searchsorted(owner, np.arange(len(column) + 1))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = np.sort(value[a:b])
        out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
    return out


def class_id(own: np.ndarray) -> int:
    """A 64-bit name of a set, never 0; equal sets have equal names."""
    if not len(own):
        return 0
    mixed = hashing.mix(np.array([hashing.mix(own).sum() + np.uint64(len(own))], np.uint64))
    return int(max(mixed[0], np.uint64(1)))


def signature(own: np.ndarray) -> np.ndarray:
    """A map with at least three bits a shingle, a power of two long, as 64-bit words."""
    size = 64
    while size < 3 * len(own):
        size *= 2
    bits = np.zeros(size, bool)
    # the place in a map half as long is the place here without its highest bit
    bits[(own & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def differing(a: Column, b: Column) -> Column:
    """Bits that two signatures differ in, at the length of the shorter one: no more than the sets differ by."""
    half = lambda s: (F.size(s) / 2).cast("int")
    fold = lambda s: F.zip_with(F.slice(s, 1, half(s)), F.slice(s, half(s) + 1, half(s)), lambda x, y: x.bitwiseOR(y))
    count = lambda s, t: F.aggregate(
        F.zip_with(s, t, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
    )
    return F.when(F.size(a) == F.size(b), count(a, b)).when(F.size(a) > F.size(b), count(fold(a), b)).otherwise(count(a, fold(b)))


def may_be_similar(n: Column, a: Column, m: Column, b: Column, num: int, den: int) -> Column:
    """By sizes and signatures; similar sets are near enough in size that their maps differ by one halving at most."""
    sizes = den * F.least(n, m) >= num * F.greatest(n, m)
    return F.when(sizes, (num + den) * (n + m - differing(a, b)) >= 2 * num * (n + m)).otherwise(False)


def cells(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(43)).astype(np.int64)


def prefix(own: np.ndarray, count: np.ndarray, mean: float, num: int, den: int) -> tuple[np.ndarray, int]:
    """The shingles that a set sends, rarest first, and how many of them a partner must share."""
    n = len(own)
    seen = count[cells(own)]
    order = np.argsort(seen, kind="stable")  # equal counts stay in hash order
    others = np.maximum(0.0, seen[order] - mean)
    met = np.cumsum(others)
    spare = n - -(-num * n // den)
    best = None
    for more in sorted({1, 1 + n // 40, 1 + n // 20, 1 + n // 10}):
        size = min(n, spare + more)
        cost = met[size - 1] + 8.0 * size + n / 4 * met[size - 1] / more
        if best is None or cost < best[0]:
            best = cost, size, more
    return own[order[: best[1]]], best[2]


def level(n, at, num: int, den: int):
    """The smallest number of matches whose prefix of a set of ``n`` reaches place ``at``."""
    return np.maximum(1, at - (n - -(-num * n // den)) + 1)


def candidates(r: np.ndarray, small: int, num: int, den: int):
    """``x, y, shared, need`` of the pairs of small lists, and the records of large lists."""
    r = r[np.lexsort((r["x"], r["key"]))]
    if len(r):
        r = r[np.r_[True, (r["key"][1:] != r["key"][:-1]) | (r["x"][1:] != r["x"][:-1])]]
    _, length = runs(r["key"])
    size = np.repeat(length, length)
    large = r[size > small]
    r = r[(size > 1) & (size <= small)]
    found = []
    field = {f: r[f].astype(np.int64) for f in ("n", "at", "need")}
    own_level = level(field["n"], field["at"], num, den)
    for gap in range(1, small):
        i = np.flatnonzero(r["key"][:-gap] == r["key"][gap:]) if len(r) > gap else np.zeros(0, np.int64)
        if not len(i):
            break
        j = i + gap
        n, m = field["n"][i], field["n"][j]
        need = np.minimum(field["need"][i], field["need"][j])
        ok = (own_level[i] <= need) & (own_level[j] <= need)
        ok &= den * np.minimum(n, m) >= num * np.maximum(n, m)
        room = np.minimum(field["at"][i], field["at"][j]) + 1
        room = room + np.minimum(n - 1 - field["at"][i], m - 1 - field["at"][j])
        ok &= (num + den) * room >= num * (n + m)
        found.append(np.stack([r["x"][i[ok]], r["x"][j[ok]], need[ok].astype(np.uint64)], 1))
    if not found:
        return np.zeros((0, 3), np.uint64), np.zeros(0, np.int64), large
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    new = np.r_[True, (every[1:, :2] != every[:-1, :2]).any(1)] if len(every) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return every[first], np.diff(np.r_[first, len(every)]), large


class _Join:
    def __init__(self, docs: DataFrame, num: int, den: int):
        self.docs, self.num, self.den = docs, num, den

    def scan(self) -> tuple[DataFrame, np.ndarray]:
        """``doc_id, th, n, x, sig`` of every document, and the counts of all cells of shingles."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = Tally(CELLS)
            for batch in shards(batches, "text"):
                sets = shingle_sets(batch.column("text"))
                count.add(cells(np.concatenate(sets)))
                ids = np.array([class_id(s) for s in sets], np.uint64).view(np.int64)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("th"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(ids),
                        pa.array([signature(s) for s in sets], pa.list_(pa.int64())),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    ["doc_id", "th", "n", "x", "sig", "slice", "part"],
                )
            part = slices(count.counts())
            nothing = [*[pa.nulls(part.num_rows, pa.int64())] * 4, pa.nulls(part.num_rows, pa.list_(pa.int64()))]
            names = ["doc_id", "th", "n", "x", "sig", "slice", "part"]
            yield pa.RecordBatch.from_arrays([*nothing, *part.columns], names)

        schema = f"doc_id long, th long, n long, x long, sig array<long>, {SUMMARY}"
        table = materialise(self.docs.mapInArrow(lean(run), schema), "sets")
        count = merged(table.where(F.col("slice").isNotNull()), CELLS, np.uint32, np.add)
        return table.where(F.col("slice").isNull()).select("doc_id", "th", "n", "x", "sig"), count

    def lists(self, count: np.ndarray) -> DataFrame:
        """Pairs ``x, y, shared, need`` of small lists, and ``x, key, n, at, need`` of large ones."""
        num, den, mean = self.num, self.den, float(count.mean())
        buckets = 2 * partitions(self.docs.sparkSession)
        # a byte a cell travels with the tasks; steps of an eighth of a doubling
        rank = np.minimum(255, 8 * np.log2(1.0 + count)).round().astype(np.uint8)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scale = 2.0 ** (np.arange(256) / 8) - 1
            dealer, seen = Dealer(buckets), set()
            about = scale[rank]
            for batch in shards(batches, "text"):
                held = []
                for own in shingle_sets(batch.column("text")):
                    x = class_id(own)
                    if x == 0 or x in seen:  # a class once per task
                        continue
                    seen.add(x)
                    sent, need = prefix(own, about, mean, num, den)
                    out = np.empty(len(sent), RECORD)
                    out["key"], out["x"], out["n"], out["need"] = sent, x, len(own), need
                    out["at"] = np.arange(len(sent))
                    held.append(out)
                if held:
                    yield from dealer.add(np.concatenate(held))
            yield from dealer.rest()

        def pairs(table: pa.Table) -> pa.Table:
            got, shared, large = candidates(records(table, RECORD), SMALL, num, den)
            n, m = len(got), len(large)
            long = lambda a: pa.array(np.ascontiguousarray(a).astype(np.uint64).view(np.int64))
            none = lambda k: pa.nulls(k, pa.int64())
            both = lambda a, b: pa.chunked_array([a, b])
            return pa.table(
                {
                    "x": both(long(got[:, 0]), long(large["x"])),
                    "y": both(long(got[:, 1]), none(m)),
                    "shared": both(long(shared), none(m)),
                    "need": both(long(got[:, 2]), long(large["need"])),
                    "key": both(none(n), long(large["key"])),
                    "n": both(none(n), long(large["n"])),
                    "at": both(none(n), long(large["at"])),
                }
            )

        dealt = self.docs.mapInArrow(lean(run), BLOCKS).groupBy("bucket")
        schema = "x long, y long, shared long, need long, key long, n long, at long"
        return materialise(dealt.applyInArrow(lean_group(pairs), schema), "shingle-lists")

    def verify(self, pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """The similar ones of pairs of classes, as edges ``u, v``; ``facts`` has ``x, n, th, sig``."""
        num, den = self.num, self.den
        one = facts.select("x", "n", "sig")
        two = facts.select(F.col("x").alias("y"), F.col("n").alias("m"), F.col("sig").alias("gis"))
        held = pairs.select("x", "y").distinct().join(one, "x").join(two, "y")
        held = held.where(may_be_similar(F.col("n"), F.col("sig"), F.col("m"), F.col("gis"), num, den))
        held = materialise(held.select("x", "y"), "pairs")
        needed = held.select("x").unionByName(held.select(F.col("y").alias("x"))).distinct()
        needed = materialise(needed.join(facts, "x").select("x", "th"), "needed")
        wanted = Bloom.of(needed.select("th"))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                th = batch.column("th").to_numpy(zero_copy_only=False)
                keep = []
                for i in np.flatnonzero(wanted.find(th)).tolist():
                    if int(th[i]) not in seen:
                        seen.add(int(th[i]))
                        keep.append(i)
                yield batch.select(["th", "text"]).take(pa.array(keep, pa.int64()))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = shingle_sets(batch.column("s")), shingle_sets(batch.column("t"))
                keep = []
                for a, b in zip(left, right, strict=True):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(den * common >= num * (len(a) + len(b) - common))
                yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

        texts = self.docs.mapInArrow(lean(fetch), "th long, text string")
        # one text of each class; other tasks may have sent the same one
        texts = needed.join(texts, "th").groupBy("x").agg(F.first("text").alias("s"))
        texts = materialise(texts, "texts")
        other = texts.select(F.col("x").alias("y"), F.col("s").alias("t"))
        both = held.join(texts, "x").join(other, "y").select(F.col("x").alias("u"), F.col("y").alias("v"), "s", "t")
        return materialise(both.mapInArrow(lean(check), "u long, v long"), "links")

    def links(self, count: np.ndarray, table: DataFrame) -> DataFrame:
        num, den = self.num, self.den
        lists = self.lists(count)
        used = lists.select("x").unionByName(lists.select(F.col("y").alias("x"))).where("x is not null").distinct()
        # one row of each class; members of a class agree in all but the text's spelling
        facts = table.join(used, "x").groupBy("x").agg(*[F.first(c).alias(c) for c in ("n", "th", "sig")])
        facts = materialise(facts, "facts")
        large = materialise(lists.where(F.col("key").isNotNull()).select("x", "key"), "large-lists")
        pairs = (
            lists.where(F.col("key").isNull())
            .groupBy("x", "y")
            .agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
        )
        if large.isEmpty():
            return self.verify(pairs.where("shared >= need"), facts)
        # shingles in large lists are not counted by pair: they may all be shared
        hidden = materialise(large.groupBy("x").agg(F.count("*").alias("hx")), "hidden")
        theirs = hidden.select(F.col("x").alias("y"), F.col("hx").alias("hy"))
        pairs = pairs.join(hidden, "x", "left").join(theirs, "y", "left")
        pairs = pairs.where("shared + coalesce(least(hx, hy), 0) >= need")
        # the head has the most shingles of large lists: what a group has in common is most of it
        head = F.min(F.struct((-F.col("hx")).alias("hx"), "x")).alias("head")
        heads = large.join(hidden, "x").groupBy("key").agg(head).select("key", F.col("head.x").alias("y"))
        # a family is what meets a head in any list; it holds every pair of each of these lists
        family = materialise(large.join(heads, "key").groupBy("y", "x").agg(F.count("*").alias("times")), "families")
        best = F.max(F.struct("times", "y")).alias("best")
        star = family.where("x <> y").groupBy("x").agg(best).select("x", F.col("best.y").alias("y"))
        links = self.verify(pairs.select("x", "y").unionByName(star), facts)
        comp = materialise(components(links), "components").withColumnsRenamed({"node": "x"})
        placed = family.select("y", "x").join(facts.select("x", "n", "sig"), "x").join(comp, "x", "left")
        placed = placed.withColumn("root", F.coalesce("root", "x"))
        rooted = comp.select(F.col("x").alias("y"), F.col("root").alias("head_root"))
        placed = placed.join(rooted, "y", "left").withColumn("head_root", F.coalesce("head_root", "y"))
        placed = materialise(placed, "placed-families")
        mine = [F.col(c).alias(f"my_{c}") for c in ("x", "n", "sig", "root")]
        outside = placed.where("root <> head_root").select("y", *mine)
        meet = outside.join(placed, "y").where("root <> my_root and (root = head_root or x < my_x)")
        meet = meet.where(may_be_similar(F.col("n"), F.col("sig"), F.col("my_n"), F.col("my_sig"), num, den))
        more = self.verify(meet.select(F.col("my_x").alias("x"), F.col("x").alias("y")), facts)
        return links.unionByName(more)


def near_duplicates(
    docs: DataFrame, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Words are runs without white space, A to Z lower-cased; a document with fewer than
    five words is one shingle, and one without words or with a null text has none and is
    linked with nothing. Documents are linked when ``den * common >= num * all``; their
    component is the smallest id that links reach. A null id takes part but never names a
    component of others. Repeated rows are documents of their own. Other columns are
    ignored; an empty table gives no rows.
    """
    slim = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.xxhash64(docs[text_col].cast("string")).alias("th"),
        docs[text_col].cast("string").alias("text"),
    )
    join = _Join(small_batches(slim), num, den)
    table, count = join.scan()
    classes = materialise(table.where("x <> 0").groupBy("x").agg(F.min("doc_id").alias("low")), "classes")
    comp = components(join.links(count, table)).withColumnsRenamed({"node": "x"})
    rooted = classes.join(comp, "x", "left").withColumn("root", F.coalesce("root", "x"))
    rooted = materialise(rooted.select("x", "root", "low"), "rooted")
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(names, "root").select("x", "component_id")
    out = table.join(named, "x", "left")
    name = F.when(F.col("x") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"))


@query("op3_ngram_jaccard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
