"""Media columns: AVI files of motion-JPEG.

``pack`` stores bytes as 8-bit grey samples: each byte is a flat 8 x 8 block, so a frame of 16 x 12 blocks is 192 bytes and
decodes to exactly these values.  With quantiser step 8 the DC coefficient is the sample minus 128; the Huffman table
gives category s a code of 9 - s bits, so that every sample takes 9 bits and one for the end of its block and a frame can be packed and
unpacked with array operations.  The files are ordinary baseline JPEG in RIFF AVI with an index.

``open_avi`` follows the RIFF lists and the index, ``decode`` the frames (any grey baseline JPEG; these flat ones fast), and ``shots`` cuts where the
histogram difference of two frames stands out from those around it.

Files are packed, hashed and decoded ``FRAMES`` frames at a time.  What grows with a text is the file itself and 256 bytes of histogram for each frame.

Defined results
* null or empty text: one frame of spaces; long texts: as many frames as needed (a file ends at 4 GB by its format: longer texts are an error);
* equal texts give equal files and features; repeated rows are returned each; null doc_id is kept; extra columns are left alone;
* ``clip_rows``: a null file has no row, a file that cannot be read one row with the ``problem`` and no clip; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, WIDE, HIGH, FPS = 192, 16, 12, 25
BINS, WINDOW = 32, 12
#: A cut's difference is beyond the median of those around it by so many (scaled) absolute deviations, and beyond the mean of sampling noise by so many of its own.
K, NOISE = 6.0, 8.0
#: Frames that are packed or decoded at once.
FRAMES = 4096
# Order of the 64 coefficients in a JPEG block (fixed values, by the zigzag rule).
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body


def _header() -> bytes:
    dc = bytes([0x00, *[1] * 9, *[0] * 7, *range(8, -1, -1)])  # lengths 1..9 for categories 8..0
    ac = bytes([0x10, 1, *[0] * 15, 0x00])  # the end of a block is the code 0
    frame = struct.pack(">BHHB", 8, HIGH * 8, WIDE * 8, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + _segment(0xDB, bytes([0, *[8] * 64])) + _segment(0xC0, frame) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


HEADER = _header()


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The 10 bits of every DC difference from -255 to 255, and the way back (-999: no code)."""
    bits = np.zeros((511, 10), np.uint8)
    back = np.full(1024, -999, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = ((1 << (8 - s)) - 1) << 1 if s else (1 << 9) - 2  # 8 - s ones and a zero; category 0: eight ones and a zero
        extra = d if d > 0 else d + (1 << s) - 1
        value = ((code << s | extra) << 1) if s else code << 1
        bits[d + 255] = [value >> (9 - k) & 1 for k in range(10)]
        back[value] = d
    return bits, back


_BITS, _BACK = _codes()
_PLACES = 1 << np.arange(9, -1, -1, dtype=np.int32)


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def pad(raw: bytes) -> bytes:
    """``raw`` with spaces up to a positive multiple of the unit."""
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def pack(payload: bytes) -> bytes:
    """An AVI file with the payload (a positive multiple of 192 bytes) as its samples."""
    n = len(payload) // UNIT
    body, sizes = [], np.zeros(n, np.int64)
    for lo in range(0, n, FRAMES):
        samples = np.frombuffer(payload, np.uint8, min(FRAMES, n - lo) * UNIT, lo * UNIT).reshape(-1, UNIT).astype(np.int16) - 128
        diff = np.diff(samples, axis=1, prepend=np.int16(0))
        packed = np.packbits(_BITS[diff + 255].reshape(len(diff), -1), axis=1)
        frames = [HEADER + row.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for row in packed]
        sizes[lo : lo + len(frames)] = [len(f) for f in frames]
        body.append(b"".join([_chunk(b"00dc", f) for f in frames]))
    most = int(sizes.max())
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDE * 8, HIGH * 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHH8I4h", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDE * 8, HIGH * 8)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDE * 8, HIGH * 8, 1, 8, b"MJPG", WIDE * HIGH * 64, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index = np.zeros((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1], index[:, 2], index[:, 3] = 0x10, 4 + np.concatenate(([0], np.cumsum(8 + sizes + (sizes & 1))[:-1])), sizes
    movi = sum(map(len, body))
    tail = _chunk(b"idx1", index.tobytes())
    total = 4 + len(head) + 12 + movi + len(tail)
    return b"".join([b"RIFF", struct.pack("<I", total), b"AVI ", head, b"LIST", struct.pack("<I", movi + 4), b"movi", *body, tail])


def open_avi(data: bytes) -> tuple[float, np.ndarray]:
    """Frames a second, and begin and end of the frames of the video, by the index (or, without one, in order of the movi list)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FPS), None, None
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if kind == b"LIST":
                what = data[at + 8 : at + 12]
                if what == b"movi":
                    movi = (at + 8, at + 8 + size)
                else:
                    todo.append((at + 12, at + 8 + size))
            elif kind == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<2I", data, at + 8 + 20)
                fps = rate / scale if scale else fps
            elif kind == b"idx1":
                index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
            at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no list of frames")
    if index is not None and len(index):
        base = movi[0] if index[0, 2] < movi[0] else 0  # offsets count from the list or from the file
        mine = index[(index[:, 0] & 0xFFFF0000) == int.from_bytes(b"\0\0dc", "little")].astype(np.int64)
        begin = base + 8 + mine[:, 2]
        return fps, np.stack((begin, begin + mine[:, 3]), 1)
    at, found = movi[0] + 4, []
    while at + 8 <= movi[1]:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at + 2 : at + 4] == b"dc":
            found.append((at + 8, at + 8 + size))
        at += 8 + size + (size & 1)
    return fps, np.array(found, np.int64).reshape(-1, 2)


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the frames."""
    fps, places = open_avi(data)
    return fps, [data[a:b] for a, b in places.tolist()]


def decode_flat(frames: list[bytes]) -> np.ndarray:
    """Samples (frame, block) of frames that ``pack`` wrote."""
    cut = len(HEADER)
    rows = b"".join([f[cut:-2].replace(b"\xff\0", b"\xff") for f in frames])
    bits = np.unpackbits(np.frombuffer(rows, np.uint8)).reshape(-1, 10)
    code = bits[:, 0].astype(np.int32)
    for k in range(1, 10):
        code = code * 2 + bits[:, k]
    diff = _BACK[code].reshape(len(frames), UNIT)
    if (diff == -999).any():
        raise ValueError("a code that is not in the table")
    return (np.cumsum(diff, axis=1) + 128).astype(np.uint8)


def decode_grey(frame: bytes) -> np.ndarray:
    """Pixels of any grey baseline JPEG, bit by bit (slow; for files of other writers)."""
    at, quant, tables, shape, restart = 2, {}, {}, None, 0
    while True:
        mark, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif mark == 0xC0:
            high, width, n = struct.unpack_from(">HHB", body, 1)
            if n != 1:
                raise ValueError("only grey frames are decoded")
            shape, q = (high, width), body[8]
        elif mark == 0xC4:
            while body:
                code, k, table = 0, 17, {}
                for length in range(1, 17):
                    for _ in range(body[length]):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = table
                body = body[k:]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            dc, ac = tables[body[2] >> 4], tables[0x10 | body[2] & 15]
            break
    scan = frame[at:]
    end = scan.rfind(b"\xff\xd9")
    pieces, last = [], 0
    scan = scan[: end if end >= 0 else len(scan)]
    for k in range(len(scan) - 1):
        if scan[k] == 0xFF and 0xD0 <= scan[k + 1] <= 0xD7:
            pieces.append(scan[last:k])
            last = k + 2
    pieces.append(scan[last:])
    rows, cols = -(-shape[0] // 8), -(-shape[1] // 8)
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    out = np.zeros((rows * 8, cols * 8))
    block = 0
    for piece in pieces:
        bits = np.unpackbits(np.frombuffer(piece.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
        pos, level = 0, 0

        def symbol(table: dict) -> int:
            nonlocal pos
            code = 0
            for length in range(1, 17):
                code = code << 1 | bits[pos]
                pos += 1
                if (length, code) in table:
                    return table[length, code]
            raise ValueError("a code that is not in the table")

        def number(s: int) -> int:
            nonlocal pos
            v = 0
            for _ in range(s):
                v = v << 1 | bits[pos]
                pos += 1
            return v if not s or v >> (s - 1) else v - (1 << s) + 1

        for _ in range(min(restart or rows * cols, rows * cols - block)):
            coef = np.zeros(64)
            level += number(symbol(dc))
            coef[0] = level * quant[q][0]
            k = 1
            while k < 64:
                s = symbol(ac)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    coef[ZIGZAG[k]] = number(s & 15) * quant[q][k]
                k += 1
            y, x = divmod(block, cols)
            out[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = basis.T @ coef.reshape(8, 8) @ basis
            block += 1
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)[: shape[0], : shape[1]]


def decode(data: bytes, places: np.ndarray) -> Iterator[np.ndarray]:
    """The samples of the frames at ``places``, up to ``FRAMES`` at once: (frame, 192) of own files; of others the pixels of each frame in a row."""
    for lo in range(0, len(places), FRAMES):
        frames = [data[a:b] for a, b in places[lo : lo + FRAMES].tolist()]
        if all(f.startswith(HEADER) for f in frames):
            yield decode_flat(frames)
        else:
            for f in frames:
                yield decode_grey(f).reshape(1, -1)


def unpack(data: bytes) -> tuple[float, np.ndarray]:
    """Frames a second and all samples."""
    fps, places = open_avi(data)
    return fps, np.concatenate(list(decode(data, places)) or [np.zeros((0, UNIT), np.uint8)])


def histograms(samples: np.ndarray) -> np.ndarray:
    """The share of each of ``BINS`` levels in every frame."""
    n = len(samples)
    counts = np.bincount((np.arange(n)[:, None] * BINS + (samples >> 3)).ravel(), minlength=n * BINS).reshape(n, BINS)
    return counts / samples.shape[1]


def cuts(hist: np.ndarray, sampled: int = UNIT, window: int = WINDOW) -> np.ndarray:
    """The frames that a cut stands before.

    The difference of two frames is half the sum of the absolute differences of their histograms.  It is a cut if it exceeds the median of up to ``window``
    differences on both sides (its own left out) by ``K`` scaled absolute deviations from it, and exceeds by ``NOISE`` deviations the mean of what
    two draws of ``sampled`` samples from one picture (with the levels' shares in both frames) would give.
    The noise is that of the two frames themselves, so first frames and short files are judged too.
    """
    if len(hist) < 2:
        return np.zeros(0, np.int64)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    share = (hist[1:] + hist[:-1]) / 2
    # each level's difference is about normal with this variance; its absolute value has mean 0.798 and variance 0.363 of it
    var = 2 * share * (1 - share) / sampled
    noise = (np.sqrt(2 * var / np.pi).sum(axis=1) + NOISE * np.sqrt((1 - 2 / np.pi) * var.sum(axis=1))) / 2
    pad = np.full(window, np.nan)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate((pad, d, pad)), 2 * window + 1)
    found = []
    for lo in range(0, len(d), FRAMES):
        part = around[lo : lo + FRAMES].copy()
        part[:, window] = np.nan
        alone = np.isnan(part).all(axis=1)
        part[alone, 0] = 0.0
        middle = np.nanmedian(part, axis=1)
        spread = 1.4826 * np.nanmedian(np.abs(part - middle[:, None]), axis=1)
        usual = np.maximum(middle + K * spread, noise[lo : lo + FRAMES])
        found.append(lo + np.flatnonzero(d[lo : lo + FRAMES] > np.round(usual, 9) + 1e-6))
    return np.concatenate(found) + 1


def shots(samples: np.ndarray, fps: float, window: int = WINDOW) -> list[tuple[int, int, float, float]]:
    """Clips ``(first frame, end frame, first second, end second)``."""
    return _clips(histograms(samples), samples.shape[1], fps, window)


def _clips(hist: np.ndarray, sampled: int, fps: float, window: int = WINDOW) -> list[tuple[int, int, float, float]]:
    edges = [0, *cuts(hist, sampled, window).tolist(), len(hist)]
    return [(a, b, a / fps, b / fps) for a, b in zip(edges, edges[1:], strict=False)]


def read_media(data: bytes) -> tuple[float, np.ndarray, int, "hashlib._Hash", bytes, float]:
    """One pass over a file's frames: frames a second, histograms, samples of a frame, SHA-256 of all samples, the last 16 of them and their mean."""
    fps, places = open_avi(data)
    sha, hist, total, count, last, wide = hashlib.sha256(), [], 0, 0, b"", UNIT
    for samples in decode(data, places):
        raw = samples.tobytes()
        sha.update(raw)
        last = (last + raw)[-16:]
        hist.append(histograms(samples))
        total, count, wide = total + int(samples.sum(dtype=np.int64)), count + samples.size, samples.shape[1]
    return fps, np.concatenate(hist or [np.zeros((0, BINS))]), wide, sha, last, total / max(1, count)


def feature(frames: int, clips: list[tuple[int, int, float, float]], mean: float) -> str:
    lengths = ",".join(f"{a:.2f}-{b:.2f}" for _, _, a, b in clips)
    return f"frames={frames};clips={len(clips)};mean={mean:.3f};times={hashlib.sha1(lengths.encode()).hexdigest()[:12]}"


def digest(docs: DataFrame) -> DataFrame:
    """Packs every whole text, reads the file back and returns its digests, its feature and its clips (first and end second)."""
    clip_type = pa.list_(pa.struct([("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                rows = []
                part = b.slice(lo, 1024)
                for doc, text in zip(part.column(0), part.column(1), strict=True):
                    raw = (text.as_py() or "").encode()
                    media = pack(pad(raw))
                    fps, hist, wide, sha, last, mean = read_media(media)
                    clips = _clips(hist, wide, fps)
                    rows.append((doc.as_py(), len(raw), len(hist) * wide, sha.hexdigest(), zlib.crc32(last), len(media), hashlib.sha256(media).hexdigest(), feature(len(hist), clips, mean), [dict(zip(("first_frame", "end_frame", "start_s", "end_s"), c, strict=True)) for c in clips]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<first_frame:bigint,end_frame:bigint,start_s:double,end_s:double>>"
    )


def write_media(docs: DataFrame) -> DataFrame:
    """``doc_id, media``: the files as a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack(pad((t.as_py() or "").encode())) for t in part.column(1)], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """``doc_id, clip, first_frame, end_frame, start_s, end_s, problem`` from ``doc_id, media``; a file that cannot be read has one row with its problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, data in zip(b.column(0), b.column(1), strict=True):
                if data.as_py() is None:
                    continue
                try:
                    fps, hist, wide, _, _, _ = read_media(data.as_py())
                    rows += [(doc.as_py(), i, *c, None) for i, c in enumerate(_clips(hist, wide, fps))]
                except (ValueError, IndexError, KeyError, TypeError, struct.error) as e:  # whatever broken bytes lead the parsers to
                    rows.append((doc.as_py(), *[None] * 5, f"{type(e).__name__}: {e}"))
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names=["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s", "problem"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, clip long, first_frame long, end_frame long, start_s double, end_s double, problem string")
