import hashlib

import pytest

from faultline.llm import warc
from faultline.session import new_folder

PAGES = [
    (1, "http://www.Example.com/a?b=1", "x" * 200),
    (2, "http://example.org:8080/", "y" * 99),
    (3, "http://example.com/a?b=1", "x" * 200),
    (4, None, None),
    (5, "not a url\nwith a break", "y" * 99),
    (6, "http://[bad", ""),
    (7, "http://example.com/long", "é\r\n\r\n" * 40_000),
    (0, "http://example.com/", "x" * 200),
    (None, "http://example.com/none", "z"),
    (9, "https://sub.example.com/", "x" * 200),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(
        [(*r, "extra", 1) for r in rows], "page_id long, url string, html string, digest string, offset int"
    ).repartition(3)


def test_pages_come_back(spark):
    found = {r.page_id: r for r in warc.archive_pages(pages(spark), block_lines=2).collect()}
    assert set(found) == {p for p, _, _ in PAGES}
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if h == html and p is not None), default=None)
        revisit = len(data) >= 100 and first != page
        assert found[page].payload_bytes == len(data)
        assert found[page].payload_digest == hashlib.sha256(data).hexdigest()
        assert found[page].record_type == ("revisit" if revisit else "response")
        assert found[page].refers_to == (first if revisit else None)


def test_repeated_rows_and_none(spark):
    assert warc.archive_pages(pages(spark, PAGES[:2] + PAGES[:2])).count() == 4
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_captures_of_one_key_over_many_blocks(spark):
    rows = [(5, "http://example.com/a", f"page {i} " * 30) for i in range(10)]
    rows += [(None, None, f"none {i} " * 30) for i in range(9)] + PAGES
    found = warc.archive_pages(pages(spark, rows), block_lines=2).collect()
    digests = sorted((r.page_id or -1, r.payload_digest) for r in found)
    assert digests == sorted((p or -1, hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in rows)


def test_part_of_a_run_begins_in_the_block_before(spark):
    rows = [(1, "http://a.example.com/", "one"), *[(2, "http://b.example.com/", "two")] * 4]
    entries = warc.write_archives(pages(spark, rows), new_folder(spark, "warc"))
    asked = spark.createDataFrame([("com,example,b)/", 2)], "urlkey string, page_id long")
    assert warc.CaptureIndex(entries.coalesce(1), block_lines=2).lookup(asked).count() == 4


def test_repeated_ids_with_other_payloads(spark):
    rows = [(1, "http://a/", "x" * 200), (2, "http://a/", "x" * 200), (2, "http://a/", "y" * 200), (2, "http://a/", "z" * 9)]
    found = warc.archive_pages(pages(spark, rows)).collect()
    kinds = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in found)
    assert kinds == [(1, 200, "response", 0), (2, 9, "response", 0), (2, 200, "response", 0), (2, 200, "revisit", 1)]


def test_lookup_opens_only_the_blocks_it_needs(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p{i}", f"page {i} " * 30) for i in range(200)]
    folder = new_folder(spark, "warc")
    entries = warc.write_archives(pages(spark, rows), folder, archive_bytes=2000)
    assert entries.select("archive").distinct().count() > 3
    index = warc.CaptureIndex(entries, block_lines=10)
    assert len(index.directory) >= 20
    keys = [(warc.reversed_host(rows[i][1]), i) for i in (3, 50, 199)] + [("zz,none)/", 5), ("", 1)]
    asked = spark.createDataFrame(keys, "urlkey string, page_id long")
    found = index.lookup(asked)
    assert sorted(r.page_id for r in found.collect()) == [3, 50, 199]
    records = {r.page_id: bytes(r.payload) for r in warc.read_records(found, folder, with_payload=True).collect()}
    assert records == {i: rows[i][2].encode() for i in (3, 50, 199)}


def test_keys():
    assert warc.reversed_host("http://www.Example.com/A?q=1") == "com,example)/a?q=1"
    assert warc.reversed_host("https://a.b.org:443") == "org,b,a)/"
    assert warc.reversed_host("http://a.org:81/x") == "org,a:81)/x"
    assert warc.reversed_host(None) == ""


def test_damaged_records_raise():
    good = warc.record_bytes(1, "http://a/", b"body", hashlib.sha256(b"body").hexdigest(), None)
    assert warc.parse_record(good)["payload"] == b"body"
    wrong = warc.record_bytes(1, "http://a/", b"body", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parse_record(wrong)
