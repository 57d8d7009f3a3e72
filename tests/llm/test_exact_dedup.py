import hashlib
from collections import Counter

import pytest

from tests.llm.cases import ROWS, fold, frame
from tickweave.llm.exact_dedup import exact_duplicates, prune


@pytest.mark.parametrize("counters", [1, 1024])
def test_matches_groups(spark, counters):
    got = exact_duplicates(frame(spark), counters=counters).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, text in ROWS:
        groups.setdefault(fold(text), []).append(i)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for h, ids in by_hash.items():
        rows = [r for r in got if r.text_sha256 == h]
        top = max((i for i in ids if i is not None), default=None)
        assert [r.doc_id for r in rows if r.kept] == [top]
        assert all(r.group_size == len(ids) and r.keep_id == top for r in rows)


def test_empty_table(spark):
    assert exact_duplicates(frame(spark, [])).count() == 0


def test_prune_keeps_heavy_values():
    counts = Counter({"a": 50, "b": 30, **{f"x{i}": 1 for i in range(10)}})
    prune(counts, 2)
    assert set(counts) == {"a", "b"} and counts["a"] == 49
