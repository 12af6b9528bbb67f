"""SimHash near-dedup by a binary-trie self-join.

``fingerprints`` reads whole texts: A-Z are lower-cased, words joined by one space, every 3-word shingle (repeats
included) hashed with XXH64 (seed 42); a bit is 1 if it is set in over half the hashes.

``link_edges`` finds all pairs of distinct fingerprints with at most ``budget`` differing bits.  Fingerprints meet in
buckets of equal bits of one of ``budget + 1`` ranges (two that differ in few bits agree in one whole range).  A bucket with
more than ``bucket_rows`` fingerprints is dealt again by ranges of its other bits, until all are small enough or no bits are left; no case is dropped.
In a bucket of any size the sorted fingerprints are a binary trie; pairs of its nodes are walked together, differing bits add up, and a pair
is given up when they exceed the budget (the tries of a batch of buckets are walked at once).  Only edges that join two parts of a bucket not joined so far are returned, so a
group of n fingerprints gives at most n - 1 edges and no link between groups is lost.

Defined results
* null, empty or blank text: fingerprint zero, linked like any other; fewer words than a shingle: the whole sequence;
* repeated rows: each row is returned, with its fingerprint's component;
* null doc_id: the row is returned; it never names a component unless no other id is there (then null);
* an empty table gives an empty result; other columns of the input are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stage

BITS = 64
_PLACE = (np.arange(8, dtype=np.int16) * 256)[None, :]
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    # how often each byte value stands at each of the eight places, times its bits
    seen = np.bincount((h.astype(">u8").view(np.uint8).reshape(n, 8) + _PLACE).ravel(), minlength=8 * 256).reshape(8, 256)
    return int.from_bytes(np.packbits((seen @ _BITS_OF).ravel() * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class _Parts:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def labels(self) -> np.ndarray:
        """The root of every position."""
        up = np.array(self.up, np.int64)
        while (up[up] != up).any():
            up = up[up]
        return up


class Walk:
    """Walks many binary tries over one array of keys (uint64, sorted within each trie) at once.

    A trie is a range of positions between two of ``cuts``; its nodes are ranges of positions that agree in their first bits.  Pairs of
    nodes of one trie and depth are walked together, in chunks, deepest first.  Children are found by counting the keys whose next bit is 0.
    A pair is given up if its differing bits exceed the budget, or if all its positions are of one part (``label``) already.
    """

    def __init__(self, keys: np.ndarray, budget: int, cuts: np.ndarray | None = None, label: np.ndarray | None = None, chunk: int = 1 << 16) -> None:
        self.keys, self.budget, self.chunk = keys, budget, chunk
        self.cuts = np.array([0, len(keys)]) if cuts is None else cuts
        self.relabel(np.arange(len(keys)) if label is None else label)

    def relabel(self, label: np.ndarray) -> None:
        self.label = label
        self._change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1]))) if len(label) else np.zeros(1, np.int64)

    def _one_part(self, pairs: np.ndarray) -> np.ndarray:
        a0, a1, b0, b1, _ = pairs.T
        return (self._change[a1 - 1] == self._change[a0]) & (self._change[b1 - 1] == self._change[b0]) & (self.label[a0] == self.label[b0])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions ``i, j`` of all pairs within the budget that are not given up; ``relabel`` may be called between two of them."""
        keys, budget = self.keys, self.budget
        lo, hi = self.cuts[:-1], self.cuts[1:]
        many = hi - lo > 1
        lo, hi = lo[many], hi[many]
        if not len(lo):
            return
        zeros: dict[int, np.ndarray] = {}
        stack = [(0, np.stack((lo, hi, lo, hi, np.zeros_like(lo)), 1))]
        while stack:
            d, pairs = stack.pop()
            if len(pairs) > self.chunk:
                stack.append((d, pairs[self.chunk :]))
                pairs = pairs[: self.chunk]
            pairs = pairs[~self._one_part(pairs)]
            leaf = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1) if d < BITS else np.ones(len(pairs), bool)
            if leaf.any():
                i, j = _positions(pairs[leaf])
                near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
                if near.any():
                    yield i[near], j[near]
                pairs = pairs[~leaf]
            if not len(pairs):
                continue
            if d not in zeros:
                zeros[d] = np.concatenate(([0], np.cumsum(((keys >> np.uint64(BITS - 1 - d)) & np.uint64(1)) == 0)))
            z = zeros[d]
            a0, a1, b0, b1, err = pairs.T
            am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
            other = a0 != b0  # of a node paired with itself one of the two mixed pairs is enough
            nxt = np.concatenate([
                np.stack((a0, am, b0, bm, err), 1), np.stack((am, a1, bm, b1, err), 1),
                np.stack((a0, am, bm, b1, err + 1), 1), np.stack((am, a1, b0, bm, err + 1), 1)[other],
            ])
            single = (nxt[:, 0] == nxt[:, 2]) & (nxt[:, 1] - nxt[:, 0] == 1)  # one position with itself
            nxt = nxt[(nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2]) & (nxt[:, 4] <= budget) & ~single]
            if len(nxt):
                stack.append((d + 1, nxt))


def _positions(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All position pairs of node pairs (at the last depth a node may hold equal keys)."""
    a0, a1, b0, b1, _ = pairs.T
    wide, n = b1 - b0, (a1 - a0) * (b1 - b0)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(wide, n)
    return np.repeat(a0, n) + k // wide, np.repeat(b0, n) + k % wide


def trie_self_join(keys: np.ndarray, budget: int, cuts: np.ndarray | None = None, chunk: int = 1 << 16) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links the keys of each trie with at most ``budget`` differing bits."""
    parts, forest, stale = _Parts(len(keys)), [], 0
    walk = Walk(keys, budget, cuts, chunk=chunk)
    for i, j in walk.pairs():
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if parts.join(a, b):
                forest.append((a, b))
                stale += 1
        if stale > len(keys) // 64:
            walk.relabel(parts.labels())
            stale = 0
    return forest


def _ranges(free: list[int], parts: int) -> list[list[int]]:
    cut = [len(free) * k // parts for k in range(parts + 1)]
    return [free[cut[k] : cut[k + 1]] for k in range(parts)]


def _join_buckets(rows: DataFrame, budget: int) -> DataFrame:
    """Edges of all buckets, a batch of whole buckets at a time; rows ``kind, bits, fp`` come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_f = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)

        def edges(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate(([True], (b[1:] != b[:-1]).any(axis=1)))
            once = new | np.concatenate(([True], f[1:] != f[:-1]))  # sorted by bucket, then key
            keys, cuts = f[once], np.append(np.flatnonzero(new[once]), once.sum())
            pairs = np.array(trie_self_join(keys, budget, cuts), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(keys[pairs[:, k]].view(np.int64)) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            b = np.concatenate((held_b, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)))
            f = np.concatenate((held_f, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(b):
                continue
            last = int(np.argmax((b == b[-1]).all(axis=1)))  # sorted: the last bucket may go on in the next batch
            held_b, held_f = b[last:], f[last:]
            if last:
                yield edges(b[:last], f[:last])
        if len(held_b):
            yield edges(held_b, held_f)

    # as unsigned numbers, whose order is that of the bits
    dealt = rows.repartition("kind", "bits").sortWithinPartitions("kind", "bits", F.col("fp").bitwiseXOR(F.lit(-(1 << (BITS - 1)))))
    return dealt.select("kind", "bits", "fp").mapInArrow(run, "u long, v long")


def link_edges(fps: DataFrame, budget: int = 2, bucket_rows: int = 65_536) -> DataFrame:
    """``u, v``: edges between distinct fingerprints (rows ``fp``) that link all that lie within ``budget`` bits, directly or by others."""
    out = None
    number = 0  # of a choice of ranges; it names the buckets of all fingerprints that were dealt by it
    # rows with the bits that are still free in them
    todo = [(fps.select("fp"), list(range(BITS)))]
    while todo:
        parts: dict[int, tuple[DataFrame, list[int]]] = {}
        for rows, free in todo:
            for bits in _ranges(free, budget + 1):
                mask = sum(1 << x for x in range(BITS) if x in bits or x not in free)
                signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
                part = rows.select("fp", F.lit(number).cast("long").alias("kind"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits"))
                parts[number] = (part, [x for x in free if x not in bits])
                number += 1
        every = reduce(DataFrame.unionByName, [part for part, _ in parts.values()])
        sizes = stage(every.groupBy("kind", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
        large = sizes.where(F.col("n") > bucket_rows)
        over = {r["kind"] for r in large.select("kind").distinct().collect()}  # kinds are few: a handful for each level
        # with no more free bits than the budget a bucket has 2 ** budget keys at most and is not dealt again
        last = [k for k, (_, free) in parts.items() if len(free) <= budget]
        fits = sizes.where((F.col("n") <= bucket_rows) | F.col("kind").isin(last))
        found = _join_buckets(every.join(fits, ["kind", "bits"], "left_semi"), budget)
        out = found if out is None else out.unionByName(found)
        todo = [(stage(parts[k][0].join(large, ["kind", "bits"], "left_semi").select("fp"), "bucket-rest"), parts[k][1]) for k in sorted(over - set(last))]
    return out


def near_duplicates(docs: DataFrame, budget: int = 2, **parameters) -> DataFrame:
    """``doc_id, fp, component_id``: one row for each document."""
    fp = stage(fingerprints(docs, **parameters), "fingerprints")
    reps = stage(fp.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    edges = stage(link_edges(reps.select("fp"), budget), "fingerprint-edges").distinct()
    found = stage(components(edges), "components")
    # groups are of fingerprints, whether their rows have ids or not
    parted = reps.join(found, reps["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("part"))
    named = parted.select("fp", "part").join(parted.groupBy("part").agg(F.min("rep").alias("component_id")), "part")
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")
