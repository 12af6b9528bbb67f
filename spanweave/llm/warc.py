"""WARC archives: writer with revisit records, and a salvage reader.

``write_archives`` puts one record for each page into archives of bounded size (a binary column; each record is one gzip
member, ``archive_bytes`` before compression at most unless one record is longer).  Of pages with equal payloads of at
least ``least`` bytes the one with the smallest page_id is a response and the others are revisits that refer to it.

``read_archives`` parses member by member.  A member that fails its checks (gzip checksum, version line, header block,
content length, block and payload digests) is quarantined: the reader searches for the next member (or, in an uncompressed archive, the next
version line) that holds a valid record, goes on from there, and logs the gap in bytes.  Every byte belongs to a record or to a gap.
Digests may be SHA-1, SHA-256, SHA-512 or MD5 in base32 or hexadecimal; one of another kind, of a revisit, or of a truncated or segmented record is not judged.
The payload of an HTTP block is its entity body.  A member may hold several records: its bytes are counted at the first, the others and gaps between them have its end as offset and length 0.

Defined results
* null html: an empty payload; null url: an empty target;
* equal payloads whose smallest page_id stands in several rows: all these rows are responses;
* null page_id: a response that no one refers to, unless an equal payload has an id: then a revisit;
* empty tables give empty results; extra columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1\r\n"
#: Over so many partitions a group of equal payloads (or of rows without an id) is dealt.
SALTS = 16
ARCHIVE_BYTES = 4 << 20
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r$")
RECORD = "archive long, offset long, length long, record_id string, record_type string, target string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(value: object) -> str:
    """One header line's value: line ends and non-ASCII go as percent escapes."""
    return "".join(c if 32 <= ord(c) < 127 and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def _unsafe(value: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value.encode()).decode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed; a revisit has no payload but keeps the digest and size of the full one."""
    digest = sha1_base32(payload)
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>",
        f"WARC-Target-URI: {_safe(url or '')}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    body = payload if refers_to is None else b""
    lines.append(f"Content-Length: {len(body)}")
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, compress: bool = True) -> DataFrame:
    """``archive, content`` from ``page_id, url, html``."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keys = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"))
    first = keys.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    # narrow rows meet by digest, a group dealt by id; the pages themselves are joined by id, and where they have none by address
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    first = first.withColumn("salt", F.explode(salts))
    met = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"])
    later = met.where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("id"), "digest", F.col("first").alias("refers_to")).distinct()
    later = later.withColumn("salt", F.explode(F.when(F.col("id").isNull(), salts).otherwise(F.array(F.lit(0)))))
    pages = pages.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("of", F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    on = pages["page_id"].eqNullSafe(later["id"]) & (pages["sha"] == later["digest"]) & (pages["of"] == later["salt"])
    rows = pages.join(later, on, "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def put() -> pa.RecordBatch:
            content = b"".join(held)
            name = int.from_bytes(hashlib.sha1(content).digest()[:8], "big", signed=True)
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([content], pa.binary())], names=["archive", "content"])

        for b in batches:
            for k in range(b.num_rows):
                page, url, html, refers = (b.column(c)[k].as_py() for c in range(4))
                raw = record(page, url, html.encode(), refers)
                if held and size + len(raw) > archive_bytes:
                    yield put()
                    held, size = [], 0
                held.append(gzip_member(raw) if compress else raw)
                size += len(raw)
        if held:
            yield put()

    return rows.mapInArrow(run, "archive long, content binary")


def _agrees(digest: str, data: bytes) -> bool | None:
    """Whether ``scheme:value`` is the digest of the data; None if it cannot be told."""
    scheme, _, value = digest.partition(":")
    name = scheme.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    own, value = hashlib.new(name, data).digest(), value.strip()
    if len(value) == 2 * len(own):
        return value.lower() == own.hex()
    if len(value.rstrip("=")) == -(-8 * len(own) // 5):
        return value.rstrip("=").upper() == base64.b32encode(own).decode().rstrip("=")
    return None


def _entity(fields: dict[str, str], block: bytes) -> bytes:
    """The payload: of an HTTP message what follows its headers, else the whole block."""
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, blank, body = block.partition(b"\r\n\r\n")
        if blank and (head.startswith(b"HTTP/") or b" HTTP/" in head.split(b"\r\n", 1)[0]):
            return body
    return block


def _unchunked(body: bytes) -> bytes | None:
    """The content of a chunked entity, or None if it is none."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0 or not re.fullmatch(rb"[0-9a-fA-F]{1,16}", body[at:end].split(b";")[0].strip()):
            return None
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _check(fields: dict[str, str], block: bytes) -> None:
    """ValueError if a digest in the headers is not that of the record."""
    if fields.get("warc-type") == "revisit" or "warc-truncated" in fields or "warc-segment-number" in fields:
        return
    if _agrees(fields.get("warc-block-digest", ""), block) is False:
        raise ValueError("block digest differs")
    body = _entity(fields, block)
    if _agrees(fields.get("warc-payload-digest", ""), body) is False:
        whole = _unchunked(body) if body is not block else None  # some writers count chunked entities as sent, some as received
        if whole is None or _agrees(fields["warc-payload-digest"], whole) is False:
            raise ValueError("payload digest differs")


def _fields(raw: bytes, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Headers of the record at ``at``, and where its body begins and ends; ValueError if it is not valid."""
    m = _LINE.match(raw, at)
    if not m:
        raise ValueError("no version line")
    end = raw.find(b"\r\n\r\n", m.end())
    if end < 0:
        raise ValueError("no end of the headers")
    head = raw[m.end() : end + 2]
    if re.search(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]", head):
        raise ValueError("control bytes in the headers")
    length = _LENGTH.search(head)
    if not length:
        raise ValueError("no content length")
    begin, stop = end + 4, end + 4 + int(length[1])
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("content length does not meet the end of the record")
    fields = {}
    for line in head.decode("latin-1").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    _check(fields, raw[begin:stop])
    return fields, begin, stop


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """``offset, length, headers, payload`` of every record, and ``offset, length, None, problem`` of every quarantined gap."""
    packed = data[:2] == b"\x1f\x8b" or (not _LINE.match(data) and b"\x1f\x8b\x08" in data)
    at, gap, problem = 0, None, ""
    while at < len(data):
        try:
            if packed:
                raw, end = _member_at(data, at)
            else:
                raw, end = data, None
            base = 0 if packed else at
            fields, begin, stop = _fields(raw, base)
            end = stop + 4 if end is None else end
        except ValueError as e:
            if gap is None:
                gap, problem = at, str(e)
            if packed:
                nxt = data.find(b"\x1f\x8b\x08", at + 1)
            else:
                m = _LINE.search(data, at + 1)
                nxt = m.start() if m else -1
            at = nxt if nxt >= 0 else len(data)
            continue
        if gap is not None:
            yield gap, at - gap, None, problem
            gap = None
        yield at, end - at, fields, _entity(fields, raw[begin:stop])
        if packed:
            yield from _rest(raw, stop + 4, end)
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, problem


def _rest(raw: bytes, at: int, end: int) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | str]]:
    """What follows the first record of a member; the member's bytes are counted there, so all this has its end as offset and length 0."""
    gap, problem = None, ""
    while at < len(raw):
        try:
            fields, begin, stop = _fields(raw, at)
        except ValueError as e:
            if gap is None:
                gap, problem = at, str(e)
            m = _LINE.search(raw, at + 1)
            at = m.start() if m else len(raw)
            continue
        if gap is not None:
            yield end, 0, None, f"{problem} ({at - gap} bytes within a member)"
            gap = None
        yield end, 0, fields, _entity(fields, raw[begin:stop])
        at = stop + 4
    if gap is not None:
        yield end, 0, None, f"{problem} ({len(raw) - gap} bytes within a member)"


def _member_at(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at``, decompressed, and its end; fed in pieces, so that a member costs its own length only."""
    z, out, pos, step = zlib.decompressobj(31), [], at, 1 << 16
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(data[pos : pos + step]))
            pos += step
    except zlib.error as e:
        raise ValueError(f"gzip: {e}") from None
    if not z.eof:
        raise ValueError("gzip: cut off")
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def read_archives(archives: DataFrame) -> DataFrame:
    """All records and gaps of ``archive, content``; ``problem`` is null for records and the cause for quarantined gaps."""
    names = [c.split(" ")[0] for c in RECORD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def number(text: str | None) -> int | None:
        return int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = []
                archive, content = b.column(0)[k].as_py(), b.column(1)[k].as_py() or b""
                for at, length, f, body in salvage(content):
                    if f is None:
                        rows.append((archive, at, length, None, None, None, None, None, None, None, None, body))
                        continue
                    digest = f.get("warc-payload-digest", "")
                    size = number(f.get("x-payload-length"))
                    rows.append((archive, at, length, f.get("warc-record-id"), f.get("warc-type"), _unsafe(f.get("warc-target-uri", "")), number(f.get("x-page-id")), number(f.get("x-refers-to-page-id")), len(body) if size is None else size, digest.removeprefix("sha1:"), body, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(len(names))], names=names)

    return archives.select("archive", "content").mapInArrow(run, RECORD)


def unresolved_revisits(records: DataFrame) -> DataFrame:
    """``refers_to, payload_digest, n`` of revisits in ``read_archives`` rows whose response (with this id and digest) is not among them."""
    records = records.where(F.col("problem").isNull())
    wanted = records.where("record_type = 'revisit'").groupBy("refers_to", "payload_digest").agg(F.count(F.lit(1)).alias("n"))  # one row for each response
    there = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return wanted.join(there, ["refers_to", "payload_digest"], "left_anti")
