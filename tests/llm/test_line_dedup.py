import numpy as np
import pytest

from tests.llm import brute
from tests.llm.cases import EXTRA, ROWS, frame, thue_morse
from tickweave.llm import line_dedup
from tickweave.llm.registry import QUERIES
from tickweave.llm.shared import documents


def texts(n=120, seed=5):
    rng = np.random.default_rng(seed)
    bases = [[f"b{k}w{i}" for i in range(12)] for k in range(6)]
    rows = []
    for d in range(n):
        out = []
        for _ in range(rng.integers(1, 6)):
            w = list(bases[rng.integers(6)])
            for k in rng.choice(12, rng.integers(0, 3), replace=False):
                w[k] = f"c{rng.integers(30)}"
            out.append(" ".join(w))
        rows.append((d, "\n".join(out)))
    return rows


def check(got, rows, columns):
    gone = brute.gone_lines(rows)
    want = []
    for i, text in rows:
        lines = text.split("\n") if text is not None else []
        keep = [x for k, x in enumerate(lines) if (i, k) not in gone]
        want.append((str(i), "\n".join(keep) if text is not None else None, len(lines), len(lines) - len(keep)))
    rows = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got if r.text is not None)
    assert rows == sorted(w for w in want if w[1] is not None)
    assert sum(r.text is None for r in got) == sum(w[1] is None for w in want)
    assert all(list(r.asDict()) == columns for r in got)


@pytest.mark.parametrize(("small", "block", "given", "heads"), [(128, 1 << 16, 2, 64), (3, 16, 2, 64), (128, 64, 0, 1), (4, 64, 0, 1)])
def test_matches_brute_force(spark, monkeypatch, small, block, given, heads):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "GIVEN", given)
    monkeypatch.setattr(line_dedup, "HEADS", heads)
    rows = texts()
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    check(got, rows, ["doc_id", "text", *EXTRA, "n_lines", "n_removed"])


def test_odd_rows(spark):
    got = line_dedup.dedup_lines(frame(spark)).collect()
    check(got, ROWS, ["doc_id", "text", *EXTRA, "n_lines", "n_removed"])


def test_the_query_compares_short_lines_too(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    want = {i: 0 for i, _ in rows}
    for i, _ in brute.gone_lines(rows, least=1):
        want[i] += 1
    assert sum(want.values()) > len(brute.gone_lines(rows))
    assert {r.doc_id: r.n_removed for r in QUERIES["op10_line_dedup"](spark, sf).collect()} == want


@pytest.mark.parametrize("small", [128, 2])
def test_short_lines_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    lines = ["yes", "Yes", "yes yes", "no", "", "  ", "a b", "b a", "a b c", "a b c d", "a b c d e", "d c b a", "a b c e", "x y z"]
    rows = [(i, "\n".join(lines[i % 14 :] + lines[: i % 5])) for i in range(20)]
    gone = brute.gone_lines(rows, least=1)
    got = line_dedup.dedup_lines(frame(spark, rows), least=1).collect()
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}
    assert {r.doc_id: r.text for r in got} == want


def test_first_candidates_may_not_be_similar(spark, monkeypatch):
    # each line is nearest to the one before it, so most have earlier candidates that are too far away
    monkeypatch.setattr(line_dedup, "GIVEN", 1)
    word = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(word[3 * i : 3 * i + 40])) for i in reversed(range(100))]
    rows += [(200 + i, " ".join([*word[2 * i : 2 * i + 30], "x", "y"])) for i in range(100)]
    check(line_dedup.dedup_lines(frame(spark, rows)).collect(), rows, ["doc_id", "text", *EXTRA, "n_lines", "n_removed"])


def test_a_null_id_comes_before_the_least_one(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(-(1 << 63), f"{line} x"), (None, f"a\n{line} y"), (0, line)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {None: 0, -(1 << 63): 1, 0: 1}


def test_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_counts_may_have_other_names(spark):
    out = line_dedup.dedup_lines(frame(spark, ROWS[:2]), counts=("a", "b"))
    assert out.columns[-2:] == ["a", "b"]


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_lines_that_a_polynomial_mixes_up(spark, size):
    one, two = thue_morse(size)
    rows = [(1, one), (2, two), (3, f"{one} z"), (4, f"{two} z")]
    got = line_dedup.dedup_lines(frame(spark, rows), least=1).collect()
    gone = brute.gone_lines(rows, least=1)
    assert {r.doc_id: r.n_removed for r in got} == {i: int((i, 0) in gone) for i, _ in rows} == dict.fromkeys(range(1, 5), 0)
