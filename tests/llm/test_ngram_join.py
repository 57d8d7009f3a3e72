import numpy as np
import pytest

from tests.llm import brute
from tests.llm.cases import ROWS, frame, thue_morse
from tickweave.llm import ngram_join
from tickweave.llm.components import components


def family(seed=3, n=60, size=120):
    """Near copies with more and more edits, so that some are linked over others only; and strangers."""
    rng = np.random.default_rng(seed)
    base = [f"t{i}" for i in range(size)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.choice(size, rng.integers(0, 6), replace=False):
            w[k] = f"e{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"s{rng.integers(40)}" for _ in range(60))) for i in range(20)]
    # one passage that strangers share
    return rows + [(2000 + i, " ".join([*base[:40], *(f"u{i}_{j}" for j in range(90))])) for i in range(45)]


@pytest.mark.parametrize("small", [2, 32])
def test_matches_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows = family() + [r for r in ROWS if r[0] is not None and r[0] not in (2,)] + [(2, ROWS[1][1])]
    rows = [(i + 5000 if i < 20 and t in dict(map(reversed, ROWS)) else i, t) for i, t in rows]
    rows = list(dict(rows).items())
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows)


def test_odd_rows(spark):
    got = ngram_join.near_duplicates(frame(spark)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == by[2] == {(15, 1)}
    # a null id takes part; a null text is linked with nothing
    assert by[None] == {(15, 1), (0, None)}
    assert by[3] == {(0, 3)} and by[5] == {(0, 5)}
    assert by[9] == by[10] == {(1, 9)}
    assert by[6] == {(5996, 6)} and by[7] == {(5997, 6)}


def test_empty_table(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


def test_signature_bounds_the_difference(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 90)).astype(np.uint64))
        b = np.unique(np.r_[a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(0, 10)).astype(np.uint64)])
        sim = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        sig = [ngram_join.signature(x).tolist() for x in (a, b)]
        rows.append((len(a), sig[0], len(b), sig[1], bool(sim)))
    df = spark.createDataFrame(rows, "n long, a array<long>, m long, b array<long>, sim boolean")
    kept = ngram_join.may_be_similar(df.n, df.a, df.m, df.b, 4, 5)
    assert df.where("sim").where(~kept).count() == 0


def test_longer_prefix_asks_for_more_matches():
    own = np.sort(np.random.default_rng(0).integers(0, 2**63, 400).astype(np.uint64))
    plain, need = ngram_join.prefix(own, np.zeros(ngram_join.CELLS), 0.0, 4, 5)
    assert (len(plain), need) == (81, 1)
    hot, more = ngram_join.prefix(own, np.full(ngram_join.CELLS, 1e6), 0.0, 4, 5)
    assert more > 1 and len(hot) == 80 + more


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (7, 3)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("size", [512, 1024, 4096])
def test_words_that_a_polynomial_mixes_up(spark, size):
    rows = list(enumerate([*thue_morse(size), *(" ".join([w] * 9) for w in thue_morse(size, "c", "d"))]))
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows)
    assert all(r.doc_id == r.component_id for r in got)
