"""k-means in exact integers with Hamerly's bounds.

Components become ``floor(256 * x)``; distances are squared sums of integers, means are floors of exact quotients, ties go to the smaller number, so
every run and partitioning gives the same result.

Each vector keeps two bounds from round to round: ``upper``, at least the distance to its centroid, and ``lower``, at most the distance to any other.  When
centroids move, the upper bound grows by its centroid's drift and the lower one shrinks by the largest drift of the others.  A vector stays
without a look at any centroid while its upper bound is below its lower bound, or below half of the way from its centroid to the next one.  Otherwise its own distance is measured and the test
repeated; a vector that is still ambiguous gets a full scan in integers.  Bounds are kept in doubles and rounded outwards; only strict inequalities decide, so no tie is lost.

Each round is a written table (vectors and bounds); the next replaces it.  Centroids (``clusters`` x 64 integers) go to the tasks, and one row of sums for each cluster comes back.

Defined results
* kept are vectors of exactly ``DIMS`` components, none null, NaN or infinite; components of 524,288 and more, whose squared distances may pass a long, count as not finite;
* null vec_id: assigned like any other, but never a first centroid; repeated rows: each counts, and equal ids may be two first centroids (in order of components);
* fewer kept vectors than clusters: as many clusters as vectors with ids; none of these: an empty result;
* sums of distances beyond a long are cut to the greatest long; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, unstage

DIMS, CLUSTERS, ROUNDS, SEED = 64, 40, 5, 2
_LIMIT = 524_288.0
#: Outward rounding of a bound; sums and roots of doubles are off by far less.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
#: Below this a sum of DIMS products of two integers is exact in a double.
_EXACT = 1 << 22
_LONG = (1 << 63) - 1
#: Rows that a task measures at once.
_ROWS = 4096


def integers(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, v``: the kept vectors as integers."""
    fine = (F.size(column) == DIMS) & F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < _LIMIT))
    return rows.where(fine).select(F.col("vec_id").cast("long"), F.transform(column, lambda x: F.floor(x.cast("double") * 256).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ``seed:vec_id`` has the smallest SHA-256."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").orderBy(order, "v").limit(clusters).select("v").collect()  # clusters rows
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, DIMS)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances of ``x`` (n x DIMS) and ``c`` (k x DIMS), exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _EXACT:
        dots = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        return (x * x).sum(axis=1)[:, None] - 2 * dots + (c * c).sum(axis=1)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], 1)


@dataclass
class Move:
    """Where the centroids are, and how far each went in the last step."""

    centroids: np.ndarray
    drift: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None = None) -> Move:
        gone = np.zeros(len(centroids)) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1)) * _UP
        return cls(centroids, gone)

    def __post_init__(self) -> None:
        apart = np.sqrt(_squares(self.centroids, self.centroids).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(axis=1) / 2 * _DOWN
        # the largest drift of the others
        first = int(np.argmax(self.drift))
        rest = np.delete(self.drift, first)
        self.others = np.full(len(self.drift), self.drift[first])
        self.others[first] = rest.max(initial=0.0)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> np.ndarray:
    """Moves the bounds, and brings ``cluster``, ``upper`` and ``lower`` up to date in place; true for rows that were scanned in full."""
    known = cluster >= 0
    at = cluster[known]
    upper[known] = (upper[known] + move.drift[at]) * _UP
    lower[known] = (lower[known] - move.others[at]) * np.where(lower[known] > move.others[at], _DOWN, _UP)
    scan = ~known
    safe = np.zeros(len(x))
    safe[known] = np.maximum(lower[known], move.half[at])
    near = np.flatnonzero(known & ~(upper < safe))
    if len(near):
        upper[near] = np.sqrt(((x[near] - move.centroids[cluster[near]]) ** 2).sum(axis=1).astype(np.float64)) * _UP
        scan[near] = ~(upper[near] < safe[near])
    rows = np.flatnonzero(scan)
    if len(rows):
        squares = _squares(x[rows], move.centroids)
        best = np.argmin(squares, axis=1)  # the first of equals
        cluster[rows] = best
        here = np.arange(len(rows))
        upper[rows] = np.sqrt(squares[here, best].astype(np.float64)) * _UP
        squares[here, best] = _LONG
        lower[rows] = np.sqrt(squares.min(axis=1).astype(np.float64)) * _DOWN if squares.shape[1] > 1 else np.inf
    return scan


_STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, scans int"


def _round(state: DataFrame, move: Move, measured: bool = False) -> DataFrame:
    """The next state; ``measured`` adds the exact squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, _ROWS):
                b = whole.slice(k, _ROWS)
                x = b.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, DIMS)
                cluster, upper, lower, scans = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in (2, 3, 4, 5))
                scans += assign(x, cluster, upper, lower, move)
                columns = [b.column(0), b.column(1), *(pa.array(c) for c in (cluster, upper, lower, scans))]
                if measured:
                    columns.append(pa.array(((x - move.centroids[cluster]) ** 2).sum(axis=1)))
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "lower", "scans", "distance"][: len(columns)])

    return state.mapInArrow(run, _STATE + ", distance long" * measured)


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; an empty cluster's centroid stays."""
    sums = [F.sum(F.col("v")[k].cast("long")).alias(f"s{k}") for k in range(DIMS)]
    out = before.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # one row for each cluster
        out[r["cluster"]] = [r[f"s{k}"] // r["n"] for k in range(DIMS)]
    return out


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, v, cluster, upper, lower, scans, distance`` (``scans``: full scans that the vector took), and the final centroids."""
    fresh = integers(rows, column).withColumns({"cluster": F.lit(-1), "upper": F.lit(0.0), "lower": F.lit(0.0), "scans": F.lit(0)})
    state = stage(fresh, "vectors")
    centroids = first_centroids(state, clusters, seed)
    if not len(centroids):
        return state.limit(0).withColumn("distance", F.lit(0).cast("long")), centroids
    move = Move.of(centroids)
    for _ in range(rounds):
        after = stage(_round(state, move), "assigned")
        unstage(state)
        state, before = after, move.centroids
        move = Move.of(_means(state, before), before)
    done = stage(_round(state, move, measured=True), "clustered")
    unstage(state)
    return done, move.centroids


def digest(rows: DataFrame, **parameters) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans``."""
    done, centroids = cluster(rows, **parameters)
    sums = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row for each cluster
    total = sum(int(r["s"]) for r in sums)
    facts = [
        (r["cluster"], min(int(r["s"]), _LONG), min(total, _LONG), hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest())
        for r in sums
    ]
    small = rows.sparkSession.createDataFrame(facts, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = done.join(F.broadcast(small), done["cluster"] == small["of"])
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
