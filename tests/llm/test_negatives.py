import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.llm.negatives import first_of, hard_negatives, scores

EXTRA = ("row", "id", "tile", "part", "packed", "anchor", "vector")
SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        *[T.StructField(x, T.StringType()) for x in EXTRA],
    ]
)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * len(EXTRA)) for r in rows], SCHEMA)


def plain(rows, every, k=5, top=3, low=50, high=95):
    own = []
    for n, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, i, label, v in own:
        if i % every:
            continue
        order = lambda p: (-p[0], p[1])
        scored = [(sum(x * y for x, y in zip(v, w)), j, m != n, z) for m, j, z, w in own]
        same = sorted([s for s in scored if s[2] and s[3] == label], key=order)[:k]
        other = sorted([s for s in scored if s[3] != label], key=order)
        for p in same:
            inside = [s for s in other if low * p[0] <= 100 * s[0] <= high * p[0]][:top]
            out += [(i, p[1], r + 1, s[1], p[0], s[0]) for r, s in enumerate(inside)]
    return sorted(out)


def made(seed, n=300, dims=8, near=False):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.3, (4, dims))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 4))
        v = base[label if near else 0] + rng.normal(0, 0.15, dims)
        # coarse values, so that scores tie
        rows.append((i, [float(np.float32(round(x * 8) / 8)) for x in v], label))
    return rows


ODD = [
    (None, [0.5] * 8, 1),
    (1000, None, 1),
    (1005, [0.5] * 7 + [None], 1),
    (1010, [0.5] * 7 + [float("nan")], 1),
    (1015, [0.5] * 7 + [float("inf")], 1),
    (1020, [0.5] * 8, None),
    (1025, [], 2),
    (1030, [0.5] * 3, 2),
    (0, [0.25] * 8, 2),
    (5, [0.25] * 8, 3),
    (5, [0.25] * 8, 3),
    (1035, [-0.5] * 8, 1),
    (1040, [0.0] * 8, 1),
]


@pytest.mark.parametrize(("seed", "near", "tile", "block"), [(1, False, 8192, 2048), (2, True, 7, 16), (3, True, 64, 50)])
def test_equal_to_all_pairs(spark, seed, near, tile, block):
    rows = made(seed, near=near) + ODD
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, "label", tile=tile, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 5)


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.75, 0.25], 2)]
    got = hard_negatives(frame(spark, rows), F.col("vec_id") == 0, "label").collect()
    assert sorted(map(tuple, got)) == [tuple(r) for r in plain(rows, 3)]
    assert hard_negatives(frame(spark, []), F.col("vec_id") % 5 == 0, "label").count() == 0
    assert hard_negatives(frame(spark, rows), F.col("vec_id") > 9, "label").count() == 0


def test_scores_are_exact_at_any_size():
    rng = np.random.default_rng(4)
    for most in (100, 1 << 20, 1 << 29):
        a, b = (rng.integers(-most, most, (5, 16)) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert scores(a, b).tolist() == want


def test_first_of_breaks_ties_by_id():
    held = np.array([(0, 0, 5, 9), (0, 0, 5, 3), (0, 0, 7, 8), (0, 1, 1, 1)], first_of(np.zeros(0, [("anchor", "<i4"), ("slot", "<i4"), ("score", "<i8"), ("id", "<i8")]), 1).dtype)
    assert first_of(held, 2)["id"].tolist() == [8, 3, 1]
