"""Long headers, and members of several records."""

from __future__ import annotations

import hashlib

from spanweave.llm import warc


def test_long_headers_are_read():
    raw = warc.record(1, "http://e.org/" + "ü" * 40_000, b"payload", None)
    for data in (raw, warc.gzip_member(raw)):
        (got,) = warc.salvage(data)
        assert got[3] == b"payload" and warc._unsafe(got[2]["warc-target-uri"]) == "http://e.org/" + "ü" * 40_000


def test_every_record_of_a_member_is_read():
    records = [warc.record(i, f"http://e.org/{i}", f"payload {i}".encode(), None) for i in range(6)]
    data = warc.gzip_member(b"".join(records[:4])) + warc.gzip_member(records[4] + b"noise" + records[5] + b"end")
    got = list(warc.salvage(data))
    assert [x[2]["x-page-id"] for x in got if x[2]] == list("012345") and sum(x[1] for x in got) == len(data)
    assert [x[3] for x in got if x[2] is None] == ["no version line (5 bytes within a member)", "no version line (3 bytes within a member)"]


def crawl_record(block: bytes, kind: str = "response", **headers: str) -> bytes:
    """A record as ordinary crawlers write it: an HTTP message with digests of block and entity body."""
    lines = [f"WARC-Type: {kind}", "Content-Type: application/http; msgtype=response", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_digests_of_http_messages():
    body = b"<p>page</p>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\n<p>p\r\n7\r\nage</p>\r\n0\r\n\r\n"
    sha = f"sha1:{warc.sha1_base32(body)}"
    good = [
        crawl_record(block, WARC_Payload_Digest=sha, WARC_Block_Digest=f"sha1:{warc.sha1_base32(block)}"),
        crawl_record(block, WARC_Payload_Digest=f"SHA-256:{hashlib.sha256(body).hexdigest().upper()}"),
        crawl_record(block, WARC_Payload_Digest=f"md5:{hashlib.md5(body).hexdigest()}"),
        crawl_record(block, WARC_Payload_Digest="xxh3:0011"),
        crawl_record(block[:-3], WARC_Payload_Digest=sha, WARC_Truncated="length"),
        crawl_record(b"HTTP/1.1 304 Not Modified\r\n\r\n", "revisit", WARC_Payload_Digest=sha),
        crawl_record(chunked, WARC_Payload_Digest=sha),
        crawl_record(chunked, WARC_Payload_Digest=f"sha1:{warc.sha1_base32(chunked.split(bytes([13, 10, 13, 10]), 1)[1])}"),
    ]
    got = list(warc.salvage(b"".join(good)))
    assert [x[2] is not None for x in got] == [True] * len(good) and got[0][3] == body
    for bad in (crawl_record(block, WARC_Payload_Digest=f"sha1:{warc.sha1_base32(b'other')}"), crawl_record(block, WARC_Payload_Digest=sha, WARC_Block_Digest=f"sha1:{warc.sha1_base32(body)}"), crawl_record(chunked, WARC_Payload_Digest="md5:" + "0" * 32)):
        x, y = warc.salvage(bad + good[0])
        assert x[2] is None and "digest differs" in x[3] and y[3] == body and x[1] + y[1] == len(bad + good[0])


def test_revisits_without_their_response_are_found(spark):
    page = "text of a page " * 9
    pages = spark.createDataFrame([(i, f"u{i}", page if i < 30 else f"{page}{i}") for i in range(40)] + [(None, f"n{k}", page) for k in range(20)], "page_id long, url string, html string")
    records = warc.read_archives(warc.write_archives(pages))
    assert records.where("record_type = 'revisit' and refers_to = 0").count() == 49 and warc.unresolved_revisits(records).count() == 0
    lost = warc.unresolved_revisits(records.where("not page_id <=> 0")).collect()
    assert [(x["refers_to"], x["n"]) for x in lost] == [(0, 49)]
