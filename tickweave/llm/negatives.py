"""Hard negatives of anchors, by scores cut into slots at the positives' upper limits.

Anchors are packed into tiles and all vectors into slabs; every tile meets every slab in one
cell of a grid, so a task holds one tile and one slab at a time whatever the table's size.

First the cells of a tile yield its anchors' positives: each keeps the best rows of the same
label, and these are merged per tile. The positives' upper limits, sorted, cut the scores
below the largest into disjoint slots. A second pass keeps in each cell the first ``top``
rows of another label per anchor and slot, again merged per tile. The window of a positive
begins at its limit and holds all slots from there down; merging the slots from the lowest
limit upwards gives the first ``top`` rows of every window at once. What lies below a
window's lower limit is cut off then: it can't push out a row inside the window, as it
scores less than any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import exchange
from tickweave.llm.registry import query
from tickweave.llm.shared import documents, lean, lean_group, materialise, partitions

#: Anchors of a tile, and of the part of it that is scored at a time; rows of a packed block; blocks of a slab at least.
TILE, PART, BLOCK, SLAB = 8192, 512, 2048, 64
#: Whole numbers below this are exact in 32-bit floats, below the other one in 64-bit floats.
EXACT32, EXACT64 = 1 << 24, 1 << 53
#: A kept candidate: anchor's place in its tile, slot, score, id.
HELD = np.dtype([("anchor", "<i4"), ("slot", "<i4"), ("score", "<i8"), ("id", "<i8")])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two whole-number matrices."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT32:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < EXACT64:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def first_of(held: np.ndarray, top: int) -> np.ndarray:
    """The first ``top`` rows of each anchor and slot: higher scores first, then smaller ids."""
    held = held[np.lexsort((held["id"], -held["score"], held["slot"], held["anchor"]))]
    group = held["anchor"].astype(np.int64) << 32 | held["slot"]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(held)) - np.repeat(starts, np.diff(np.r_[starts, len(held)]))
    return held[rank < top]


def _candidates(at: tuple, slot, score: np.ndarray, ids: np.ndarray, start: int) -> np.ndarray:
    """Candidates of a part of a tile that begins at its anchor ``start``."""
    out = np.empty(len(at[0]), HELD)
    out["anchor"], out["slot"], out["score"], out["id"] = at[0] + start, slot, score[at], ids[at[1]]
    return out


class Positives:
    """Keeps the first rows of the same label for every anchor of a tile."""

    def __init__(self, tile: dict, top: int):
        self.tile, self.top, self.held = tile, top, np.zeros(0, HELD)
        self.least = np.full(len(tile["id"]), np.iinfo(np.int64).min)

    def add(self, block: dict) -> None:
        found = [self.held]
        for start in range(0, len(self.least), PART):
            part = slice(start, start + PART)
            score = scores(self.tile["vector"][part], block["vector"])
            same = self.tile["label"][part, None] == block["label"][None, :]
            same &= self.tile["row"][part, None] != block["row"][None, :]
            same &= score >= self.least[part, None]
            found.append(_candidates(np.nonzero(same), 0, score, block["id"], start))
        self.held = first_of(np.concatenate(found), self.top)
        full = np.flatnonzero(np.bincount(self.held["anchor"], minlength=len(self.least)) == self.top)
        last = np.searchsorted(self.held["anchor"], full, "right") - 1
        self.least[full] = self.held["score"][last]


class Slots:
    """Keeps the first rows of another label for every anchor of a tile and slot."""

    def __init__(self, tile: dict, top: int):
        self.tile, self.top, self.held = tile, top, np.zeros(0, HELD)
        #: limits of each anchor, largest first; unused ones repeat the last
        self.limits = tile["limits"]
        self.last = self.limits.shape[1] - 1
        self.least = tile["least"].copy()

    def add(self, block: dict) -> None:
        found = [self.held]
        for start in range(0, len(self.least), PART):
            part = slice(start, start + PART)
            score = scores(self.tile["vector"][part], block["vector"])
            wanted = self.tile["label"][part, None] != block["label"][None, :]
            wanted &= score <= self.limits[part, :1]
            wanted &= score >= self.least[part, None]
            at = np.nonzero(wanted)
            # the slot is that of the lowest limit which is not below the score
            slot = (self.limits[part][at[0]] >= score[at][:, None]).sum(1) - 1
            found.append(first_of(_candidates(at, slot, score, block["id"], start), self.top))
        self.held = first_of(np.concatenate(found), self.top)
        # the lowest slot is in all windows: what it holds in full bounds all that may still come
        low = self.held[self.held["slot"] == self.last]
        full = np.flatnonzero(np.bincount(low["anchor"], minlength=len(self.least)) == self.top)
        last = np.searchsorted(low["anchor"], full, "right") - 1
        self.least[full] = np.maximum(self.least[full], low["score"][last])


def _pack(rows: dict) -> bytes:
    flat = {k: pa.array(v) for k, v in rows.items() if v.ndim == 1}
    wide = {k: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]) for k, v in rows.items() if v.ndim == 2}
    return exchange.packed(flat | wide)


def _unpack(value: pa.Scalar) -> dict:
    batch, out = exchange.unpacked(value), {}
    for name in batch.schema.names:
        column = batch.column(name)
        if pa.types.is_fixed_size_list(column.type):
            size = column.type.list_size
            out[name] = column.flatten().to_numpy().reshape(len(column), size)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """``part, packed``: the rows of each task, ``size`` at a time; shorter vectors are filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.slice(start, size)
                lists = part.column("vector").cast(pa.large_list(pa.int64()))
                n = pc.list_value_length(lists).to_numpy().astype(np.int64)
                matrix = np.zeros((len(part), max(1, int(n.max(initial=0)))), np.int64)
                matrix[np.arange(matrix.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
                rows = {c: part.column(c).cast(pa.int64()).to_numpy() for c in ("row", "id", "label")}
                small = np.abs(matrix).max(initial=0) < 1 << 15
                rows["vector"] = matrix.astype(np.int16) if small else matrix
                yield pa.RecordBatch.from_arrays([pa.array([_pack(rows)], pa.binary())], ["packed"])

    return vectors.mapInArrow(lean(run), "packed binary").select(F.monotonically_increasing_id().alias("part"), "packed")


def _same_width(a: dict, b: dict) -> tuple[dict, dict]:
    wide = max(a["vector"].shape[1], b["vector"].shape[1])
    fill = lambda x: x | {"vector": np.pad(x["vector"], ((0, 0), (0, wide - x["vector"].shape[1]))).astype(np.int64)}
    return fill(a), fill(b)


def _grid(tiles: DataFrame, blocks: DataFrame, combiner, top: int, slabs: int) -> DataFrame:
    """``tile, packed``: what the combiner keeps of every cell of the grid of tiles and slabs."""
    count = tiles.count()

    def cell(table: pa.Table) -> pa.Table:
        parts = table.column("packed")
        is_tile = table.column("is_tile").to_pylist()
        tile = next((_unpack(p) for p, t in zip(parts, is_tile, strict=True) if t), None)
        kept = None
        for p, t in zip(parts, is_tile, strict=True):
            if t or tile is None:
                continue
            own, block = _same_width(tile, _unpack(p))
            kept = kept or combiner(own, top)
            kept.tile = own
            kept.add(block)
        held = kept.held if kept else np.zeros(0, HELD)
        packed = exchange.packed({c: pa.array(held[c]) for c in HELD.names})
        return pa.table({"tile": table.column("tile")[:1], "packed": pa.array([packed], pa.binary())})

    placed = tiles.select("tile", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), "packed", F.lit(True).alias("is_tile"))
    spread = blocks.where(F.lit(count > 0)).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, count - 1)).cast("long"))).alias("tile"),
        F.pmod(F.xxhash64("part"), F.lit(slabs)).cast("int").alias("slab"),
        "packed",
        F.lit(False).alias("is_tile"),
    )
    cells = placed.unionByName(spread).groupBy("tile", "slab")
    return cells.applyInArrow(lean_group(cell), "tile long, packed binary")


def _held(parts: Iterator[pa.Scalar]) -> np.ndarray:
    found = [np.zeros(0, HELD)]
    for part in parts:
        columns = exchange.unpacked(part)
        rows = np.empty(len(columns), HELD)
        for c in HELD.names:
            rows[c] = columns.column(c).to_numpy()
        found.append(rows)
    return np.concatenate(found)


def _per_tile(tiles: DataFrame, kept: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(tile number, tile, all that its cells kept)`` for every tile."""

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_pylist()
        parts = table.column("packed")
        tile = next(_unpack(p) for p, t in zip(parts, own, strict=True) if t)
        held = _held(p for p, t in zip(parts, own, strict=True) if not t)
        return fn(table.column("tile")[0].as_py(), tile, held)

    both = tiles.withColumn("own", F.lit(True)).unionByName(kept.withColumn("own", F.lit(False)))
    return both.groupBy("tile").applyInArrow(lean_group(run), schema)


def hard_negatives(
    vectors: DataFrame,
    anchor,
    label,
    positives: int = 5,
    negatives: int = 3,
    limits: tuple[int, int] = (50, 95),
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tile: int = TILE,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a condition that marks the anchors, ``label`` the column or expression of
    the label. Components become ``floor(scale * x)``; a score is the inner product of these
    whole numbers, exact up to 64 bits. Higher scores come first, then smaller ids. The
    positives of an anchor are its first ``positives`` other rows of the same label; each
    gets its first ``negatives`` rows of another label whose score, times 100, lies between
    the two ``limits`` times the positive's score.

    Rows with a null id, label or vector, or with a component that is null or not finite,
    take no part. Vectors of unequal length count as filled up with zeros, so an empty one
    scores 0. Repeated rows are rows of their own, an anchor is only never its own positive;
    rows with equal ids and scores can't be told apart in the result. Other columns are
    ignored, and an empty table gives no rows.
    """
    x = F.transform(vector_col, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    clean = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        F.when(F.coalesce(finite, F.lit(False)), x).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null and vector is not null")
    clean = materialise(clean, "vectors")
    spark = vectors.sparkSession
    # one packed row is what an Arrow batch holds of a task
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(block))
    try:
        blocks = materialise(_blocks(clean.drop("anchor"), block), "blocks")
        pieces = materialise(_tiles(clean.where("anchor").drop("anchor"), tile), "tiles")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    n_blocks = blocks.count()
    slabs = max(1, min(n_blocks, max(2 * partitions(spark), n_blocks // SLAB)))
    low, high = limits

    def limited(number: int, own: dict, held: np.ndarray) -> pa.Table:
        held = first_of(held, positives)
        n = len(own["id"])
        count = np.bincount(held["anchor"], minlength=n)
        rank = np.arange(len(held)) - np.repeat(np.cumsum(count) - count, count)
        score = np.zeros((n, positives), np.int64)
        ids = np.zeros((n, positives), np.int64)
        has = np.arange(positives) < count[:, None]
        score[held["anchor"], rank], ids[held["anchor"], rank] = held["score"], held["id"]
        # a negative positive score leaves an empty window, below all limits that count
        open_ = has & (score >= 0)
        upper = np.where(open_, score * high // 100, -1)
        least = np.where(open_, -(-score * low // 100), np.iinfo(np.int64).max).min(1)
        own |= {"limits": upper, "least": least, "positive": ids, "score": score, "has": has.astype(np.int8)}
        return pa.table({"tile": pa.array([number], pa.int64()), "packed": pa.array([_pack(own)], pa.binary())})

    def windows(number: int, own: dict, held: np.ndarray) -> pa.Table:
        held = first_of(held, negatives)
        # suffix merges: from the lowest slot up, each window is its slot and the window below
        merged = []
        below = np.zeros(0, HELD)
        for slot in reversed(range(positives)):
            below = np.concatenate([below, held[held["slot"] == slot]])
            below["slot"] = slot
            below = first_of(below, negatives)
            merged.append(below.copy())
        rows = np.concatenate(merged)
        rows = rows[np.lexsort((rows["id"], -rows["score"], rows["slot"], rows["anchor"]))]
        at, slot = rows["anchor"], rows["slot"]
        score = own["score"][at, slot]
        keep = own["has"][at, slot].astype(bool) & (score >= 0) & (100 * rows["score"] >= low * score)
        # equal limits have one slot, the lowest of them, and equal windows
        rows, at, slot, score = rows[keep], at[keep], slot[keep], score[keep]
        group = at.astype(np.int64) * positives + slot
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) + 1
        return pa.table(
            {
                "anchor_id": pa.array(own["id"][at]),
                "positive_id": pa.array(own["positive"][at, slot]),
                "rank": pa.array(rank, pa.int32()),
                "negative_id": pa.array(rows["id"]),
                "positive_score": pa.array(score),
                "negative_score": pa.array(rows["score"]),
            }
        )

    best = _grid(pieces, blocks, Positives, positives, slabs)
    ready = materialise(_per_tile(pieces, best, limited, "tile long, packed binary"), "limits")
    kept = _grid(ready, blocks, Slots, negatives, slabs)
    return _per_tile(
        ready,
        kept,
        windows,
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
    )


def _tiles(anchors: DataFrame, size: int) -> DataFrame:
    """``tile, packed``: anchors in tiles numbered from 0, none with much more than ``size`` rows."""
    count = max(1, -(-anchors.count() // size))
    names = ["row", "id", "label", "vector"]

    def pack(table: pa.Table) -> pa.Table:
        part = table.combine_chunks()
        lists = part.column("vector").combine_chunks().cast(pa.large_list(pa.int64()))
        n = pc.list_value_length(lists).to_numpy().astype(np.int64)
        matrix = np.zeros((len(part), max(1, int(n.max(initial=0)))), np.int64)
        matrix[np.arange(matrix.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
        own = {c: part.column(c).to_numpy() for c in names[:3]} | {"vector": matrix}
        return pa.table({"tile": part.column("tile")[:1], "packed": pa.array([_pack(own)], pa.binary())})

    dealt = anchors.select(F.pmod(F.xxhash64("row"), F.lit(count)).alias("tile"), *names)
    return dealt.groupBy("tile").applyInArrow(lean_group(pack), "tile long, packed binary")


SQL = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select a.id as anchor_id, b.id as other, a.label = b.label as same,
    cast(list_sum([a.e[i] * b.e[i] for i in range(1, len(a.e) + 1)]) as bigint) as score
  from v a join v b on a.id <> b.id where a.id % 50 = 0
), p as (
  select * from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5
), n as (
  select p.anchor_id, p.other as positive_id, p.score as positive_score, s.other as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same
    and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from n where rank <= 3
"""


@query("op12_hard_negatives", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = documents(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, moved)
