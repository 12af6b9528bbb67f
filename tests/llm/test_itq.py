"""Embedding near-dedup against all pairs."""

from __future__ import annotations

import math
from collections import Counter

import __spark_entry__
import numpy as np
import pytest

from spanweave.llm import itq

from .test_hamerly import write


def near(r, v, cosine):
    """A vector at exactly this cosine, but for rounding."""
    v = v / np.linalg.norm(v)
    w = r.normal(size=len(v))
    w -= (w @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def table(seed=3, n=300):
    r = np.random.default_rng(seed)
    base = list(r.normal(size=(n, 64)))
    for k in range(40):
        base += [near(r, base[k], c) * r.uniform(0.1, 9) for c in (0.945, 0.951, 0.96, 0.97, 0.99, 0.9999)]
    hub = base[50]
    base += [near(r, hub, r.uniform(0.955, 0.9999)) for _ in range(250)]  # a group of which some link and some do not
    tight = base[51]
    base += [tight + r.normal(size=64) * 0.01 for _ in range(300)]
    base += [base[52]] * 30 + [base[52] * 2] * 4
    rows = [(k, [float(x) for x in v], k % 10) for k, v in enumerate(base)]
    i = len(rows)
    odd = [None, [], [0.0] * 64, [math.nan] + [1.0] * 63, [math.inf] * 64, [None] + [1.0] * 63, [-0.0] * 64]
    rows += [(i + k, v, 0) for k, v in enumerate(odd)]
    rows += [(i + 20, [1.0, 2.0], 0), (i + 21, [1.0, 2.01], 0), (i + 22, rows[0][1] + [0.0], 0), (i + 23, rows[0][1] * 3, 0), (i + 24, rows[1][1] * 3, 0), (i + 25, rows[1][1] * 3, 1)]
    rows += [(None, rows[2][1], None), (None, [9.0, -3.0, 1.0], 0), rows[3], rows[3], (-5, rows[60][1], 0), (7, rows[61][1], 0), (i + 30, [3e37] * 64, 0), (i + 31, [1e-38] * 64, 0)]
    return rows


def brute(rows):
    """Link counts and components by all pairs, in single precision inputs as stored."""
    units = {}
    for k, (_, v, *_) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            x /= np.abs(x).max()
            units[k] = x / np.linalg.norm(x)
    links = {k: set() for k in range(len(rows))}
    for size in {len(u) for u in units.values()}:
        at = [k for k, u in units.items() if len(u) == size]
        m = np.stack([units[k] for k in at])
        for i, j in zip(*np.nonzero(m @ m.T >= 0.95), strict=True):
            if i != j:
                links[at[i]].add(at[j])
    out, done = [None] * len(rows), set()
    for k in range(len(rows)):
        if k not in done:
            part, todo = {k}, [k]
            while todo:
                new = links[todo.pop()] - part
                part |= new
                todo += new
            done |= part
            least = min((rows[x][0] for x in part if rows[x][0] is not None), default=None)
            for x in part:
                out[x] = (rows[x][0], len(links[x]), least, rows[x][0] == least)
    return Counter(out)


def found(df):
    return Counter(tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect())


def test_op13(spark, tmp_path):
    rows = table()
    got, want = found(__spark_entry__.queries()["op13_embedding_dedup"](spark, write(tmp_path, rows))), brute(rows)
    assert sum(got.values()) == len(rows)
    # retrieval may miss a pair in 500 near the cosine; nothing is linked below it
    assert sum((got & want).values()) >= len(rows) - 4
    assert sum(k[1] * n for k, n in got.items()) >= 0.999 * sum(k[1] * n for k, n in want.items())
    most = {k: n for k, n, *_ in want}
    assert all(n <= most[k] for k, n, *_ in got if k is not None and list(r[0] for r in rows).count(k) == 1)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0] * 64, 0)], [(4, [1.0], 0), (3, [2.0], 0), (2, [-1.0], 0)], [(k, [1.0] * 64, 0) for k in range(40)]], ids=["none", "null", "one", "one component", "copies"])
def test_small_tables(spark, tmp_path, rows):
    assert found(__spark_entry__.queries()["op13_embedding_dedup"](spark, write(tmp_path, rows))) == brute(rows)


def test_large_buckets_lose_no_pair(spark):
    r = np.random.default_rng(2)
    middle = r.integers(0, 1 << 63, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in r.choice(64, int(n), replace=False)) for n in r.integers(0, 6, 300)]
    codes = sorted({int(np.uint64(middle) ^ np.uint64(f)) for f in flips})
    df = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "code long")
    want = {(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 11}
    got = {tuple(sorted((r["u"] % 2**64, r["v"] % 2**64))) for r in itq.near_codes(df, budget=11, bucket_rows=40).collect()}
    assert got == want
    assert {tuple(sorted((r["u"] % 2**64, r["v"] % 2**64))) for r in itq.near_codes(df, budget=11).collect()} == want


def test_recall_at_the_cosine():
    r = np.random.default_rng(8)
    x = r.normal(size=(4000, 64))
    y = np.stack([near(r, v, 0.95) for v in x])
    q = itq.Quantiser(x[:2000] / np.linalg.norm(x[:2000], axis=1, keepdims=True))
    a, b = q.codes(x / np.linalg.norm(x, axis=1, keepdims=True)), q.codes(y)
    met = np.zeros(4000, bool)
    for t in range(itq.TABLES):
        at = np.full(4000, t)
        met |= np.bitwise_count(itq._substring(a, at) ^ itq._substring(b, at)) <= 2
    assert (met & (np.bitwise_count(a ^ b) <= itq.BUDGET)).mean() > 0.99
    ones = np.unpackbits(a.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
    assert abs(ones - 0.5).max() < 0.06
