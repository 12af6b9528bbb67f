"""Cuts, long and broken files, and the whole query against plain code."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from spanweave.llm import media

from .conftest import prose


def plain_cuts(samples: np.ndarray) -> list[int]:
    """The rule of ``media.cuts`` frame by frame."""
    hist = [[sum(v >> 3 == b for v in f) / len(f) for b in range(media.BINS)] for f in samples.tolist()]
    d = [sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 2 for a, b in zip(hist, hist[1:], strict=False)]
    out = []
    for i, x in enumerate(d):
        share = [(a + b) / 2 for a, b in zip(hist[i], hist[i + 1], strict=True)]
        var = [2 * p * (1 - p) / samples.shape[1] for p in share]
        noise = (sum((2 * v / np.pi) ** 0.5 for v in var) + media.NOISE * ((1 - 2 / np.pi) * sum(var)) ** 0.5) / 2
        others = d[max(0, i - media.WINDOW) : i] + d[i + 1 : i + 1 + media.WINDOW] or [0.0]
        middle = float(np.median(others))
        spread = 1.4826 * float(np.median([abs(o - middle) for o in others]))
        if x > round(max(middle + media.K * spread, noise), 9) + 1e-6:
            out.append(i + 1)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_cuts_follow_the_rule(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 30, r.integers(1, 6))
    samples = np.concatenate([r.integers(lo := r.integers(0, 150), lo + r.integers(1, 100), (n, 192)) for n in lengths]).astype(np.uint8)
    assert media.cuts(media.histograms(samples)).tolist() == plain_cuts(samples)


def test_steady_clips_are_left_whole_and_changes_found():
    r = np.random.default_rng(7)
    false = missed = 0
    for k in range(60):
        wide = int(r.integers(1, 120))
        low = int(r.integers(0, 250 - wide))
        steady = r.integers(low, low + wide, (300, 192)).astype(np.uint8)
        false += len(media.cuts(media.histograms(steady)))
        other = r.integers(200 - low // 2, 210 - low // 2 + 5, (40, 192)).astype(np.uint8)
        at = int(r.integers(1, 299))
        found = media.cuts(media.histograms(np.concatenate((steady[:at], other)))).tolist()
        missed += at not in found
    assert false <= 2 and missed <= 6


def test_long_files_are_handled_in_parts(monkeypatch):
    raw = media.pad(np.random.default_rng(2).integers(0, 256, 100_000).astype(np.uint8).tobytes())
    whole = media.pack(raw), media.read_media(media.pack(raw))
    monkeypatch.setattr(media, "FRAMES", 7)
    again = media.pack(raw)
    assert again == whole[0]
    fps, hist, wide, sha, last, mean = media.read_media(again)
    assert (fps, wide, last, sha.hexdigest()) == (25.0, 192, raw[-16:], hashlib.sha256(raw).hexdigest()) and np.array_equal(hist, whole[1][1]) and mean == whole[1][5]


def test_broken_files_are_quarantined(spark):
    good = media.pack(media.pad(b"some text " * 100))
    rows = [(1, bytearray(good)), (2, bytearray(b"RIFF")), (3, bytearray(good[:-2000])), (4, None), (5, bytearray(good[:400] + b"\0" * 300 + good[700:])), (6, bytearray(b""))]
    got = media.clip_rows(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["problem"] is None and by[1]["end_frame"] == 6 and set(by) == {1, 2, 3, 5, 6} and all(by[k]["problem"] and by[k]["clip"] is None for k in (2, 5, 6))


def test_query_against_plain_code(spark, tmp_path):
    import random

    r = random.Random(4)
    texts = [None, "", "x" * 192, "ü" * 500, prose(r, 700), prose(r, 40) * 30, "A" * 4000 + "z" * 4000, "A" * 4000 + "z" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in media.digest(docs).collect()}
    for i, t in enumerate(texts):
        raw = media.pad((t or "").encode())
        samples = np.frombuffer(raw, np.uint8).reshape(-1, 192)
        edges = [0, *plain_cuts(samples), len(samples)]
        clips = [(a, b, a / 25, b / 25) for a, b in zip(edges, edges[1:], strict=False)]
        times = hashlib.sha1(",".join(f"{a / 25:.2f}-{b / 25:.2f}" for a, b, _, _ in clips).encode()).hexdigest()[:12]
        x = got[i]
        assert [tuple(c) for c in x["clips"]] == clips and x["feature"] == f"frames={len(samples)};clips={len(clips)};mean={samples.mean():.3f};times={times}"
        assert (x["payload_sha256"], x["tail_crc32"], x["media_sha256"]) == (hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), hashlib.sha256(media.pack(raw)).hexdigest())
    assert [c["first_frame"] for c in got[6]["clips"]] == [0, 20, 21, 41]  # frames 20 and 41 are half of one letter, half of another
