from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections import defaultdict
from pathlib import Path

import pytest

from panelstats.llm import warc


def check(df, rows):
    """Digests and types against plain Python; of equal payloads the largest id is the response."""
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[digest(h)].append(i)
    got = df.collect()
    assert sorted((str(r.id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len((h or "").encode()), digest(h)) for i, _, h in rows)
    for d, ids in groups.items():
        mine = [r for r in got if r.payload_digest == d]
        top = max((i for i in ids if i is not None), default=None)
        responses = [r for r in mine if r.record_type == "response"]
        assert len(responses) == 1 and responses[0].id == top and responses[0].refers_to is None
        assert all(r.record_type == "revisit" and r.refers_to == top for r in mine if r is not responses[0])


def test_round_trip_of_odd_pages(spark, written):
    rows = [(i, f"http://x.org/{i}", f"<p>page {i % 7}</p>\r\n\r\nWARC/1.0\r\n é🙂") for i in range(60)]
    rows += [(100, None, None), (101, "http://a b\n/c", ""), (None, "u", "<p>page 1</p>\r\n\r\nWARC/1.0\r\n é🙂"), (None, "u", "lone"), (102, "u", "x" * 300_000)]
    rows += [(103, "u", "twice"), (103, "u", "twice"), (-5, "u", "neg"), (-6, "u", "neg")]
    df = written(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string"), 4)
    check(warc.round_trip(df), rows)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_pages_and_files(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").repartition(3)
    arcs, warcs = str(tmp_path / "arc"), str(tmp_path / "warc")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    check(warc.round_trip(pages, arcs=arcs, warcs=warcs), rows)
    versions, seen = set(), {}
    for f in Path(arcs).glob("part*"):
        first = gzip.open(f).readline().decode()
        versions.add(gzip.open(f).read()[len(first)])
        assert first.startswith("filedesc://")
    assert versions == {ord("1"), ord("2")}
    for f in Path(warcs).glob("part*"):
        for head, block in warc.parse_warc(io.BytesIO(gzip.open(f).read())):
            if head["warc-type"] != "warcinfo":
                seen[head["warc-target-uri"], warc.http_parts(block)[1]["x-page-id"]] = warc.http_parts(block)[2]
                assert head["warc-date"] == "2000-01-01T00:00:00Z" and head["warc-block-digest"] == "sha1:" + warc.base32_sha1(block)
    assert seen == {(u, str(i)): h.encode() for i, u, h in rows}


def archive(version, *records):
    body = b"\n".join([warc.arc_version_block(version, "n.arc"), *(warc.arc_record(version, u, b, "n.arc") for u, b in records)])
    return io.BytesIO(body + b"\n")


@pytest.mark.parametrize("version", [1, 2])
def test_parser_goes_by_declared_lengths(version):
    found = list(warc.parse_arc(archive(version, ("http://a/", b"\n\nhttp://b/ 0.0.0.0 1 text/html 3\n"), ("http://b/x y", b""), ("http://c/", b"z"))))
    assert [(v, f["URL"], c) for v, _, f, c in found] == [(version, "http://a/", b"\n\nhttp://b/ 0.0.0.0 1 text/html 3\n"), (version, "http://b/x%20y", b""), (version, "http://c/", b"z")]


def test_broken_archives_raise():
    whole = archive(1, ("http://a/", b"abc")).getvalue()
    with pytest.raises(ValueError, match="declares 3 bytes"):
        list(warc.parse_arc(io.BytesIO(whole[:-3])))
    with pytest.raises(ValueError, match="5 fields"):
        list(warc.parse_arc(io.BytesIO(whole + b"http://b/ text/html 3\nabc\n")))
    with pytest.raises(ValueError, match="isn't known"):
        list(warc.parse_arc(io.BytesIO(b"filedesc://x 0.0.0.0 1 text/plain 4\n7 0 \n")))
    with pytest.raises(ValueError, match="begins with"):
        list(warc.parse_warc(io.BytesIO(b"HTTP/1.0\r\n")))


def test_dates():
    assert warc.iso_time("19961231235959") == "1996-12-31T23:59:59Z"
    assert warc.iso_time("1996") == "1996-01-01T00:00:00Z"
