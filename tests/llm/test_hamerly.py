"""Centroid clustering against full scans in Python integers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import __spark_entry__
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanweave.llm import hamerly

KIND = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])


def write(folder, rows, schema=KIND):
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r, strict=False)) for r in rows], schema), f"{folder}/embeddings.parquet")
    return str(folder)


def vectors(n, seed=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    return [(k, [x + r.gauss(0, 0.3) for x in r.choice(centres)], 0) for k in range(n)]


def odd():
    rows = vectors(150)
    rows += [(200, None, 0), (201, [], 1), (202, [1.0] * 63, 1), (203, [1.0] * 65, 1), (204, [math.nan] + [1.0] * 63, 1), (205, [math.inf] + [1.0] * 63, 1), (206, [None] + [1.0] * 63, 1)]
    rows += [(None, rows[3][1], 0), rows[4], rows[4], (5, rows[6][1], 0), (207, [0.0] * 64, None), (208, [-0.0] * 64, None), (209, [1000.0, -1000.0] * 32, 0)]
    return rows + [(300 + k, rows[7][1], 0) for k in range(60)]  # a group of copies


def plain(rows, clusters=40, rounds=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first[:clusters]]
    if not centroids:
        return Counter()

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for k in set(found):
            mine = [v for (_, v), f in zip(kept, found, strict=True) if f == k]
            centroids[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    done = [nearest(v) for _, v in kept]
    inertia = Counter()
    for d, k in done:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, done, strict=True))


NAMES = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def found(spark, folder):
    return Counter(tuple(r[n] for n in NAMES) for r in __spark_entry__.queries()["op12_centroid_clustering"](spark, folder).collect())


@pytest.mark.parametrize("rows", [odd(), [], vectors(3), [(None, [1.0] * 64, 0)], [(1, [1.0] * 64, 0)] * 50], ids=["odd", "none", "three", "no id", "copies"])
def test_op12(spark, tmp_path, rows):
    assert found(spark, write(tmp_path, rows)) == plain(rows)


def test_sql(spark, tmp_path):
    folder = write(tmp_path, odd())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    rows = db.sql(f"SELECT {', '.join(NAMES)} FROM ({__spark_entry__.oracle_sql()['op12_centroid_clustering']})").fetchall()
    assert Counter(rows) == plain(odd())


def test_bounds_save_scans_and_change_nothing():
    r = np.random.default_rng(0)
    x = (r.normal(0, 90, (40, 64))[r.integers(0, 40, 4000)] + r.normal(0, 25, (4000, 64))).astype(np.int64)
    centroids = x[:40].copy()
    cluster, upper, lower, scans = np.full(4000, -1, np.int32), np.zeros(4000), np.zeros(4000), 0
    move = hamerly.Move.of(centroids)
    for step in range(12):
        scanned = hamerly.assign(x, cluster, upper, lower, move)
        scans += int(scanned.sum()) if step else 0
        squares = ((x[:, None] - move.centroids[None]) ** 2).sum(axis=2)
        assert (cluster == squares.argmin(axis=1)).all()
        own = np.sqrt(squares[np.arange(4000), cluster].astype(float))
        squares[np.arange(4000), cluster] = 1 << 62
        assert (upper >= own).all() and (lower <= np.sqrt(squares.min(axis=1).astype(float))).all()
        after = move.centroids.copy()
        for k in range(40):
            if (cluster == k).any():
                after[k] = x[cluster == k].sum(axis=0) // (cluster == k).sum()
        move = hamerly.Move.of(after, move.centroids)
    assert scans < 0.5 * 11 * 4000


def test_extra_columns_and_doubles(spark):
    rows = [(k, [float(k)] * 64, "x", 1) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, cluster string, v int")
    assert [(r["vec_id"], r["cluster"]) for r in hamerly.digest(df, clusters=3, rounds=1).orderBy("vec_id").collect()] == [
        (i, c) for i, c in sorted((i, k) for k, (_, i) in enumerate(sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i) for i in range(3))))
    ]
