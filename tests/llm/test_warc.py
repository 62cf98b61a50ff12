"""WARC archives: exact round trip, byte ranges, revisits and odd pages."""

import hashlib

from cladewise.llm import warc
from cladewise.llm.scratch import shared_dir

BIG = "<p>" + "x" * 2000 + "é🙂</p>"


def pages(spark):
    rows = [(1, "http://a/ü", BIG), (5, "http://b/", BIG), (3, None, BIG), (2, "u", "small"), (4, "u", "small"), (6, "n", None), (7, "e", ""), (8, "c", "a\r\n\r\nWARC/1.1\r\n" * 200)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string"), rows


def test_round_trip(spark):
    df, rows = pages(spark)
    out = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert len(out) == len(rows)
    for page_id, url, html in rows:
        raw, r = (html or "").encode(), out[page_id]
        assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(raw), hashlib.sha1(raw).hexdigest(), url or "")
        again = page_id in (1, 3)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if again else ("response", None))


def test_selected_records_by_coalesced_ranges(spark, monkeypatch):
    df, rows = pages(spark)
    folder = shared_dir(spark)
    index = warc.write_archives(warc.plan_revisits(df).coalesce(1), folder)
    picked = index.filter("page_id IN (2, 8)")
    assert warc.ranges(picked).count() <= 2
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(picked, folder).collect()}
    assert got == {2: "small", 8: rows[-1][2]}
    monkeypatch.setattr(warc, "READ_BYTES", 64)
    assert warc.ranges(index).count() > 2
    assert warc.read_records(index, folder).count() == len(rows)


def test_ties_nulls_and_empty(spark):
    schema = "page_id long, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    out = warc.round_trip(spark.createDataFrame([(2, "a", BIG), (2, "a", BIG), (None, "b", BIG), (1, "c", BIG)], schema)).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in out) == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)]
