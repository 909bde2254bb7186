import gzip
import hashlib
import os

import pytest

from verdigraph import runtime
from verdigraph.llm import warc

FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (1, "http://a/", "<p>é</p>" * 50),
    (2, "http://b/\r\nX: y", FAKE * 40),
    (3, None, None),
    (4, "u", ""),
    (7, "u", FAKE * 40),
    (5, "u", FAKE * 40),
    (5, "u", "twice"),
    (5, "u", "twice"),
    (None, "u", "twice"),
    (None, "u", "no id"),
    (9, "u", "\x1f\x8b\x08" * 2000 + "x" * 100000),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], "page_id long, url string, html string, payload string, size int")


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("block", [1 << 22, 997])
def test_round_trip(spark, packed, block):
    manifest = warc.write_archives(pages(spark, ROWS).coalesce(1), runtime.fresh_path(spark, "w"), packed)
    got = warc.read_archives(manifest, packed, block).collect()
    assert len(got) == len(ROWS)
    first = {}
    for i, _, html in ROWS:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = set()
    for i, _, html in ROWS:
        raw = (html or "").encode()
        least = first.get(html or "")
        ref = least if least is not None and (i is None or i > least) else None
        want.add((i, len(raw), warc.payload_digest(raw), "response" if ref is None else "revisit", ref))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    for r in got:
        if r.record_type == "response":
            assert warc.payload_digest(bytes(r.payload)) == r.payload_digest
    assert {r.url for r in got if r.page_id == 2} == {"http://b/%0D%0AX: y"}


def test_archives_are_plain_warc(spark):
    folder = runtime.fresh_path(spark, "w")
    manifest = warc.write_archives(pages(spark, ROWS[:2]).coalesce(1), folder).collect()
    path = manifest[0].uri.removeprefix("file:").replace("///", "/")
    raw = gzip.open(path).read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and os.path.getsize(path) == manifest[0].size
    assert hashlib.sha1(ROWS[0][2].encode()).digest()


def test_damage_raises(spark):
    manifest = warc.write_archives(pages(spark, ROWS).coalesce(1), runtime.fresh_path(spark, "w"), False)
    row = manifest.first()
    path = row.uri.removeprefix("file:").replace("///", "/")
    data = bytearray(open(path, "rb").read())
    at = data.index(b"<p>")
    data[at] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(manifest, False).collect()
    open(path, "wb").write(data[: len(data) // 2])
    cut = spark.createDataFrame([(row.uri, len(data) // 2)], "uri string, size long")
    with pytest.raises(Exception, match="broken|no record"):
        warc.read_archives(cut, False, 997).collect()


def test_empty(spark):
    manifest = warc.write_archives(pages(spark, []), runtime.fresh_path(spark, "w"))
    assert warc.read_archives(manifest).count() == 0
