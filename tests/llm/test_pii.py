import hashlib
import re

from tests.llm.cases import ROWS, frame
from tickweave.llm.pii import occurrences, personal_data, read

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c_d@e.f x@y@z.com @@ a@b a@b.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0.0.0.0 00001.2.3.4 1.2.3",
    "4539 1488 0343 6467, 4539148803436467 4539-1488-0343-6468 1 2 3",
    "+1 (017) 555-7713 +1 +12 +1+2 3 4 5 6 7 8 9 +4930123456",
    "é漢😀 mail é@x.de m@x.de\n10.0.0.1\t" + "9" * 300,
    "a@b" + ".c" * 20_000,
    "z" * 50_000 + "1" * 50_000,
    "a@a.aa@b.b1.1.1.1",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def spans(text):
    return [
        [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m.group())]
        for k, p in PATTERNS.items()
    ]


def test_base_matches_the_patterns(spark):
    rows = [*ROWS, *[(100 + i, t) for i, t in enumerate(TEXTS)]]
    got = personal_data(frame(spark, rows)).collect()
    want = []
    for i, text in rows:
        own = spans(text)
        digest = hashlib.sha256(",".join(x for k in own for x in k).encode()).hexdigest()
        want.append((str(i), *map(len, own), digest))
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == sorted(want)
    assert all(r.n_added == 0 for r in got)


def test_trusted_context_finds_unseen_identifiers(spark):
    """``phone`` before and ``today`` after surround known numbers; a number in another form stands there too."""
    seen = [(i, f"my phone +1 555 01{i:02d} 7777 today please") for i in range(12)]
    other = [(50 + i, f"the year {1900 + i} ended and page {1200 + i} too") for i in range(12)]
    unseen = [(90, "my phone 0171/5550199 today please")]
    got = {r.doc_id: r for r in personal_data(frame(spark, seen + other + unseen)).collect()}
    assert got[90].n_added == 1 and got[90].spans == "phone:9:21" and got[90].n_phone == 0
    assert all(got[i].n_added == 0 for i, _ in other)
    assert all(got[i].n_phone == 1 for i, _ in seen)


def test_the_surest_discovery_is_kept(spark):
    """Eighteen trusted patterns of 12/13 each: the confidence rounds to 1.0, as that of a seed."""
    sides = [(f"left{x}", f"right{x}") for x in "abcdef"]
    seen = [(12 * k + i, f"{a} +1 555 01{i:02d} 7777 {b}") for k, (a, b) in enumerate(sides) for i in range(12)]
    unseen = [(900 + k, f"{a} 0171/5550199 {b}") for k, (a, b) in enumerate(sides)]
    got = {r.doc_id: r for r in personal_data(frame(spark, seen + unseen)).collect()}
    assert all(got[900 + k].spans == "phone:6:18" and got[900 + k].n_added == 1 for k in range(6))
    assert all(got[i].n_added == 0 and got[i].n_phone == 1 for i, _ in seen)


def test_contexts_of_emails_are_learned(spark):
    """Texts without a digit: known addresses teach the context, an address without a dot is found in it."""
    seen = [(i, f"please write to some{chr(97 + i)}@mail.example.org for details") for i in range(12)]
    unseen = [(90, "please write to someone@localhost for details"), (91, "nothing to see for details")]
    got = {r.doc_id: r for r in personal_data(frame(spark, seen + unseen)).collect()}
    assert got[90].spans == "email:16:33" and got[90].n_added == 1 and got[90].n_email == 0
    assert all(got[i].n_email == 1 and got[i].n_added == 0 for i, _ in seen) and got[91].spans == ""


def test_any_match_of_a_run_makes_it_known(spark):
    """The first address of the run is none; the second is."""
    got = occurrences(read(frame(spark, [(1, "from 256.1.1.1 10.0.0.1 on")]), "doc_id", "text")).collect()
    assert [(r.token, r.kind) for r in got] == [("256.1.1.1 10.0.0.1", "ip")]


def test_empty_table(spark):
    assert personal_data(frame(spark, [])).count() == 0
