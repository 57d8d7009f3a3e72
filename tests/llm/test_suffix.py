import hashlib

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.cases import PASSAGE, ROWS, frame, thue_morse
from tickweave.llm.suffix import common_prefixes, covered, remove_repeats, suffix_array


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array_is_sorted(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, rng.integers(1, 6), rng.integers(1, 400)).astype(np.uint8)
    raw = x.tobytes()
    array = suffix_array(x, 10**6)
    assert array.tolist() == sorted(range(len(x)), key=lambda i: raw[i:])
    a, b = array[:-1], array[1:]
    fits = (a + 5 <= len(x)) & (b + 5 <= len(x))
    got = common_prefixes(x, a[fits], b[fits], 5)
    for i, j, n in zip(a[fits], b[fits], got, strict=True):
        k = 0
        while k < 5 and raw[i + k] == raw[j + k]:
            k += 1
        assert n == k


def test_covered_joins_runs():
    assert covered(np.array([[5, 9], [0, 3], [3, 5], [20, 22]])).tolist() == [[0, 9], [20, 22]]


def rows():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefé"), 6))
    base = " ".join(word() for _ in range(120))
    out = [(100 + i, " ".join([word(), base[i * 7 :], word()])) for i in range(6)]
    out += [(200 + i, base[:300] + word() + base[300:]) for i in range(4)]
    out += [(300, "ab" * 150), (301, "x" * 90), (302, base[:80]), (303, base[10:91]), (304, "q" + "\0" * 200)]
    return [*ROWS[:8], (11, PASSAGE), (12, "before it " + PASSAGE + " after it"), *out]


def test_matches_brute_force(spark):
    length = 80
    data = rows()
    got = remove_repeats(frame(spark, data), length=length, gram=16).collect()
    raw = [(t or "").encode() for _, t in data]
    want = []
    for (i, _), b, flags in zip(data, raw, brute.repeated(raw, length), strict=True):
        kept = bytes(x for x, f in zip(b, flags, strict=True) if not f)
        edges = sum(1 for k, f in enumerate(flags) if f and (k == 0 or not flags[k - 1]))
        want.append((str(i), len(b), len(b) - len(kept), edges, hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(want)
    assert all(bytes(r.kept) is not None and len(r.removed) == 2 * r.n_spans for r in got)


def test_empty_table(spark):
    assert remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_strings_that_a_polynomial_mixes_up(spark, size):
    one, two = thue_morse(size)
    data = [(1, one), (2, two), (3, "x" + one)]
    got = remove_repeats(frame(spark, data), length=size, gram=16).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: size, 2: 0, 3: size}
    texts = np.frombuffer(f"{one}{two}".encode(), np.uint8)
    assert common_prefixes(texts, np.array([0]), np.array([size]), size).tolist() == [0]
