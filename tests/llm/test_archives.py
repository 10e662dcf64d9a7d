from __future__ import annotations

import base64
import hashlib

import pytest

from ledgerweave.llm import archives

SCHEMA = "page_id long, url string, html string, payload string, refers_to int"
ROWS = [
    (1, "http://a/x y", "<p>one</p>", "x", 1),
    (2, None, None, "x", 1),
    (3, "", "", "x", 1),
    (4, "http://a/4", "<p>one</p>", None, None),
    (5, "http://a/5", "line\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\n1 2 3\n", "x", 1),
    (None, "http://a/n", "<p>one</p>", "x", 1),
    (None, "http://a/m", "only here é😀", "x", 1),
    (6, "http://a/6", "same row", "x", 1),
    (6, "http://a/6", "same row", "x", 1),
    (7, "http://a/7", "z" * 3_000_000, "x", 1),
]


def expected(rows):
    out, first = [], {}
    for page_id, *_, html in sorted([(r[0], r[2]) for r in rows], key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        first.setdefault(payload, page_id)
        revisit = first[payload] != page_id
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append(
            (page_id, len(payload), digest, "revisit" if revisit else "response", first[payload] if revisit else None)
        )
    return sorted(out, key=repr)


def got(frame):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted([tuple(r[n] for n in names) for r in frame.collect()], key=repr)


@pytest.mark.parametrize("file_records", [3, 4000])
def test_round_trip(spark, file_records):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    assert got(archives.round_trip(pages, file_records=file_records)) == expected(ROWS)


def test_given_pages(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    assert got(archives.round_trip(pages)) == expected(rows)


def test_short_payloads_may_stay_responses(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    kinds = {r["page_id"]: r["record_type"] for r in archives.round_trip(pages, least_bytes=5).collect()}
    assert kinds[3] == "response" and kinds[4] == "revisit"


def test_no_rows(spark):
    assert archives.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_both_versions_and_other_records():
    body = b"20260101 0 1\nexample.org A 1.2.3.4\n"
    for version in (1, 2):
        data = archives.version_block(version, "f.arc") + b"\n"
        given = {"URL": "dns:example.org", "IP-address": "1.2.3.4", "Content-type": "text/dns"}
        data += archives.header_line(version, given, "2005", len(body)) + body + b"\n"
        data += archives.arc_record(version, 9, "http://h/", "hi\n") + b"\n"
        records = [archives.converted(*r) for r in archives.arc_records(data)]
        assert [r["kind"] for r in records] == ["warcinfo", "resource", "response"]
        assert records[1]["payload"] == body and records[2]["payload"] == b"hi\n"
        assert records[2]["page_id"] == 9 and records[2]["date"] == "2000-01-01T00:00:00Z"
        warc = b"".join(archives.warc_record(r, None) + b"\n" for r in records)
        back = list(archives.warc_records(warc))
        assert [b for _, b in back][1] == body
        assert all(f["warc-block-digest"] == "sha1:" + archives.sha1_base32(b) for f, b in back)


def test_dates_and_damage():
    assert archives.warc_date("20051231235958") == "2005-12-31T23:59:58Z"
    whole = archives.version_block(1, "f") + b"\n" + archives.arc_record(1, 1, "http://h/", "text")
    with pytest.raises(ValueError, match="ends within"):
        list(archives.arc_records(whole[:-2]))
    with pytest.raises(ValueError, match="header line"):
        list(archives.arc_records(archives.version_block(1, "f") + b"\nnot a header\n"))
