import hashlib

import pytest

from tickweave.llm.warc import parse, read_records, record, write_bundles

BIG = "<p>" + "x" * 1200
PAGES = [
    (1, "http://a/", BIG),
    (2, "http://b/\r\nInjected: x", BIG),
    (3, None, BIG),
    (None, "http://n/", BIG),
    (4, "http://c/", "small"),
    (5, "http://d/", "small"),
    (6, "http://e/", None),
    (7, "http://f/", ""),
    (8, "http://g/", "é" * 700),
    (9, "http://h/", "y" * 400_000),
    (9, "http://h/", "y" * 400_000),
]


def table(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as digest", "1 as same")


def test_round_trip(spark, tmp_path):
    index = write_bundles(table(spark), f"file://{tmp_path}/w", frame_bytes=2000, bundle_bytes=4000)
    got = read_records(index).collect()
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == raw and p is not None]
        other = max(same) if len(raw) >= 1000 and page != max(same) else None
        want.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", other))
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((str(r.page_id), *r[1:5]) for r in got), key=key) == sorted(want, key=key)
    assert not any("Injected" in (r.url or "").split("%0A")[0] for r in got)


def test_one_record_by_its_place(spark, tmp_path):
    index = write_bundles(table(spark), f"file://{tmp_path}/w", frame_bytes=2000)
    one = read_records(index.where("page_id = 8")).collect()
    assert [(r.page_id, r.payload_bytes) for r in one] == [(8, 1400)]


def test_damaged_payload_is_an_error(spark, tmp_path):
    index = write_bundles(table(spark, PAGES[:1]), f"file://{tmp_path}/w")
    path = index.first().bundle.removeprefix("file://")
    from tickweave.llm.warc import Bundle, Seekable

    row = index.first()
    data = Seekable(row.bundle).read(row.frame, row.at, row.length)
    bundle = Bundle(f"file://{path}")
    bundle.frame(data.replace(b"xxxx", b"xxxy", 1))
    bundle.close()
    with pytest.raises(Exception, match="damaged"):
        read_records(index).collect()


def test_record_parses():
    fields, http, payload = parse(record(7, "u", b"body", hashlib.sha1(b"body").hexdigest(), None, "d"))
    assert fields["WARC-Type"] == "response" and http["Content-Length"] == "4" and payload == b"body"


def test_empty_table(spark, tmp_path):
    index = write_bundles(table(spark, []), f"file://{tmp_path}/w")
    assert index.count() == 0 and read_records(index).count() == 0
