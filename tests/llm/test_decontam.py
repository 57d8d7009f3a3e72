from tests.llm import brute
from tests.llm.cases import PASSAGE, ROWS, frame
from tickweave.llm.decontam import contained_items, without_items

ITEMS = [
    (1, PASSAGE),
    (2, "One TWO"),
    (3, None),
    (4, ""),
    (5, "one two three four five six seven eight"),
    (6, " ".join(PASSAGE.split()[:40] + ["x"] * 6)),
    (None, "before it passage0 passage1"),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "z") for r in rows], "item_id long, text string, words string")


def want(rows):
    out = set()
    for i, text in rows:
        for j, item in ITEMS:
            q, d = brute.shingles(item), brute.shingles(text)
            if q and 5 * len(q & d) >= 4 * len(q):
                out.add((i, j, len(q), len(q & d)))
    return out


def test_matches_brute_force(spark):
    rows = [*ROWS, (50, "one two three four five six seven eight"), (51, "x one two three four five six seven")]
    got = contained_items(frame(spark, rows), items(spark)).collect()
    assert {tuple(r) for r in got} == want(rows) and len(got) == len(want(rows))


def test_leaky_documents_go_and_the_rest_stays(spark):
    left = without_items(frame(spark), items(spark)).collect()
    leaky = {i for i, *_ in want(ROWS)}
    assert sorted(str(r.doc_id) for r in left) == sorted(str(i) for i, _ in ROWS if i not in leaky)


def test_empty_tables(spark):
    assert contained_items(frame(spark, []), items(spark)).count() == 0
    assert contained_items(frame(spark), items(spark, [])).count() == 0
    assert without_items(frame(spark), items(spark, [])).count() == len(ROWS)
