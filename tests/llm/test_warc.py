"""Operator 10: framing, digests, revisits, round trips."""

import gzip
import hashlib
import io
import random
import zlib

import pytest

from teachspark.llm.warc import archive_pages, read_records, record


def member(data):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def make(payloads):
    return b"".join(member(record(i, f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None)) for i, p in enumerate(payloads))


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_round_trip_at_any_chunk_size(chunk):
    random.seed(chunk)
    payloads = [b"", b"a", b"\r\n\r\n" * 9, random.randbytes(3000), b"WARC/1.1\r\n" * 50]
    got = list(read_records(io.BytesIO(make(payloads)), chunk, payloads=True))
    assert [r["payload"] for r in got] == payloads and all(r["ok"] for r in got)
    assert all(gzip.decompress(make(payloads)[r["offset"] :])[:8] == b"WARC/1.1" for r in got)


def test_damage_is_found():
    whole = make([b"hello world" * 30, b"second" * 40])
    with pytest.raises((ValueError, zlib.error)):
        list(read_records(io.BytesIO(whole[:-20])))
    good = record(1, None, b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    assert [r["ok"] for r in read_records(io.BytesIO(member(good.replace(b"\r\n\r\nhello", b"\r\n\r\njello"))))] == [False]
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(member(good + b"more"))))
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(member(good.replace(b"Content-Length: 5\r\n\r\nhello", b"Content-Length: 5\r\n\r\nhell")))))


def test_pages_with_revisits_and_edges(spark):
    big, small = "<p>" + "y" * 200 + "</p>", "z" * 99
    rows = [(5, "u5", big), (3, "u3", big), (9, None, big), (3, "u3", big), (1, "é ?", small), (2, "u2", small), (7, "u7", None), (8, "u8", ""), (None, "u", big), (11, "u11", "é" * 50), (12, "u12", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' as digest", "'own' as refers_to")
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.ok) for r in archive_pages(spark, pages).collect())
    first = {big: 3, "é" * 50: 11}
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        to = first.get(html) if len(data) >= 100 and first.get(html) != page_id else None
        want.append((page_id or 0, len(data), hashlib.sha256(data).hexdigest(), "revisit" if to else "response", to, True))
    assert got == sorted(want, key=lambda x: (x[:4], x[4] or 0)) or sorted(map(str, got)) == sorted(map(str, want))
    assert archive_pages(spark, pages.limit(0)).count() == 0
