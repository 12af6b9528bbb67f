"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

1. *Codes.*  On a bounded sample (``SAMPLE`` distinct vectors, those with the smallest hashes) principal axes are rotated until the signs lose least (iterative
   quantisation), with near copies in the sample left out; each axis is cut at the median, so that bits are balanced.  Every vector gets a code of 64 bits.
2. *Cells.*  Equal vectors are one, with a count.  Of the vectors of one code those within half of the linking angle of the code's first vector (by hash) form a cell, in
   which all link; any other is a cell of its own.  A group of n near copies becomes a few cells, and their pairs are counted, never listed.
3. *Tables.*  A code is cut into four substrings of 16 bits.  It is put into its table under its substring and all that differ from it in one bit, so codes that
   differ in at most two bits of any substring meet.  That takes in all pairs with up to 11 differing bits and most beyond; vectors at a cosine of 0.95 differ in 6.5 of 64 bits
   on the average and miss each other with a chance of 1 in 500.  Buckets above ``bucket_rows`` are cut into blocks, and each pair of blocks is dealt by itself.
4. *Reranking.*  Cells whose codes differ in ``budget`` bits at most are compared by their vectors.  The angle of the two first vectors and the cells' radii tell that all
   members link, or none; between these the members themselves are compared, in blocks of ``BLOCK``.

Links are exact: none is below the cosine, and any pair that is retrieved and reaches it is counted.  Only retrieval (3, and the budget) can miss a pair.

Defined results
* null or empty vectors, zeros, and vectors with null, NaN or infinite components link with nothing; vectors of different lengths do not link;
* lengths other than the commonest are folded to it for their codes only;
* repeated rows and equal vectors are other vectors that link (cosine 1); rows of one id each count;
* null vec_id: the row is returned and counts as a link; it names a component only if no other id is there (then null, and it is kept);
* an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import stage, wider

COSINE = 0.95
BITS, WIDTH = 64, 16
TABLES = BITS // WIDTH
#: Distinct vectors that the rotation is fitted on.
SAMPLE = 4096
#: Differing bits of two codes whose vectors are compared, at most: at the cosine above 16 is four deviations beyond the mean.
BUDGET = 16
BUCKET_ROWS = 8192
#: Members of a cell that are compared at once with those of another.
BLOCK = 32
#: Angles are told apart by their cosines in doubles, which near 1 are good to 2e-8; cells are taken this much narrower and wider.
_SLACK = 1e-6
_ITERATIONS = 50


def _vector_rows(rows: DataFrame, column: str) -> DataFrame:
    """``vec_id, key, vec``: the bytes of each usable vector and their 128-bit hash, null for others."""
    kind = rows.schema[column].dataType.elementType
    exact = np.dtype("<f4" if isinstance(kind, T.FloatType) else "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vecs = [], []
            for v in b.column(1):
                x = v.values
                key = vec = None
                if x is not None and len(x) and not x.null_count:
                    x = x.to_numpy(zero_copy_only=False).astype(exact) + exact.type(0)  # -0.0 becomes 0.0
                    if np.isfinite(x).all() and x.any():
                        vec = x.tobytes()
                        key = hashlib.blake2b(vec, digest_size=16).digest()
                keys.append(key)
                vecs.append(vec)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names=["vec_id", "key", "vec"])

    return rows.select(F.col("vec_id").cast("long"), column).mapInArrow(run, "vec_id long, key binary, vec binary")


def _units(vecs: list[bytes], kind: np.dtype) -> np.ndarray:
    """Unit vectors, as doubles, of equal lengths."""
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _folded(x: np.ndarray, length: int) -> np.ndarray:
    if x.shape[1] == length:
        return x
    more = -x.shape[1] % length
    return np.pad(x, ((0, 0), (0, more))).reshape(len(x), -1, length).sum(axis=1)


class Quantiser:
    """Projections and cuts that give a vector its code."""

    def __init__(self, sample: np.ndarray, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.length = sample.shape[1]
        mean = sample.mean(axis=0)
        centred = sample - mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, : min(BITS, self.length)]
        v = centred @ axes
        turns = []
        for _ in range(-(-BITS // v.shape[1])):  # short vectors: several rotations
            turn, _ = np.linalg.qr(r.normal(size=(v.shape[1],) * 2))
            for _ in range(_ITERATIONS):
                a, _, b = np.linalg.svd(np.sign(v @ turn).T @ v)
                turn = (a @ b).T
            turns.append(turn)
        self.project = (axes @ np.concatenate(turns, axis=1))[:, :BITS]
        self.cut = np.median(sample @ self.project, axis=0)

    def codes(self, units: np.ndarray) -> np.ndarray:
        bits = _folded(units, self.length) @ self.project > self.cut
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def _by_length(vecs: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    size = np.fromiter(map(len, vecs), np.int64, len(vecs))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, [vecs[i] for i in at]


def _with_codes(vectors: DataFrame, q: Quantiser, kind: np.dtype) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column("vec").to_pylist()
            out = np.zeros(len(vecs), np.uint64)
            for at, same in _by_length(vecs):
                out[at] = q.codes(_units(same, kind))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out.view(np.int64))], names=[*b.schema.names, "code"])

    return vectors.mapInArrow(run, wider(vectors.schema, code=T.LongType()))


def _fit(vectors: DataFrame, kind: np.dtype, sample: int) -> Quantiser:
    size = vectors.groupBy(F.length("vec").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()["size"]
    rows = vectors.where(F.length("vec") == size).orderBy("key").limit(sample).select("vec").collect()  # sample rows
    return Quantiser(_thinned(_units([bytes(r["vec"]) for r in rows], kind)))


def _thinned(units: np.ndarray, cosine: float = 0.9, block: int = 512) -> np.ndarray:
    """Vectors without an earlier one at this cosine, so that a group of near copies does not pull the axes and the cuts to itself."""
    keep = np.ones(len(units), bool)
    for k in range(0, len(units), block):
        near = units[k : k + block] @ units[: k + block].T >= cosine
        keep[k : k + block] = ~np.tril(near, k - 1).any(axis=1)
    return units[keep]


def _angles(u: list[bytes], v: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and angle of each pair; pairs of different lengths are opposite."""
    cos = np.full(len(u), -1.0)
    same = np.array([len(a) == len(b) for a, b in zip(u, v, strict=True)], bool)
    for at, part in _by_length(u):
        at = at[same[at]]
        if len(at):
            cos[at] = np.clip((_units([u[i] for i in at], kind) * _units([v[i] for i in at], kind)).sum(axis=1), -1, 1)
    return cos, np.arccos(cos)


def _members(coded: DataFrame, kind: np.dtype, cosine: float) -> DataFrame:
    """``key, mult, least, code, cell, radius``: each vector's cell and its angle to the cell's first vector."""
    widest = np.arccos(cosine) / 2 - _SLACK
    first = coded.groupBy("code").agg(F.min(F.struct("key", "vec")).alias("first")).select(F.col("code").alias("c"), F.col("first.key").alias("cell"), F.col("first.vec").alias("lead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, angle = _angles(b.column("vec").to_pylist(), b.column("lead").to_pylist(), kind)
            own = [c == k for c, k in zip(b.column("cell").to_pylist(), b.column("key").to_pylist(), strict=True)]
            angle[own] = 0.0
            inside = angle <= widest
            cell = [c if i else k for c, k, i in zip(b.column("cell").to_pylist(), b.column("key").to_pylist(), inside, strict=True)]
            columns = [b.column(n) for n in ("key", "mult", "least", "code")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.binary()), pa.array(np.where(inside, angle, 0.0))], names=["key", "mult", "least", "code", "cell", "radius"])

    return coded.join(first, coded["code"] == first["c"]).drop("c").mapInArrow(run, "key binary, mult long, least long, code long, cell binary, radius double")


def _substring(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (code >> (table * WIDTH).astype(np.uint64)) & np.uint64((1 << WIDTH) - 1)


def _meeting_here(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the least of the keys under which substrings ``a`` and ``b`` both stand."""
    diff = a ^ b
    low = diff & (~diff + np.uint64(1))
    n = np.bitwise_count(diff)
    two = np.minimum(a ^ low, b ^ low)
    return key == np.where(n == 0, a, np.where(n == 1, np.minimum(a, b), two))


def _spread(codes: DataFrame) -> DataFrame:
    """``table, key, code``: each code under its substrings and all one bit off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate(([0], 1 << np.arange(WIDTH))).astype(np.uint64)
        for b in batches:
            code = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(code), 4096):
                c = code[k : k + 4096].view(np.uint64)
                for t in range(TABLES):
                    keys = (_substring(c, np.full(len(c), t))[:, None] ^ flips).ravel().astype(np.int32)
                    columns = [np.full(len(keys), t, np.int32), keys, np.repeat(c, len(flips)).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["table", "key", "code"])

    return codes.select("code").mapInArrow(run, "table int, key int, code long")


_BUCKET = ["table", "key", "one", "two"]


def _bucket_pairs(rows: DataFrame, budget: int) -> DataFrame:
    """``u, v``: codes within the budget of a bucket or of two of its blocks; rows ``table, key, one, two, block, code``, ``one`` = ``two`` for a whole bucket or a block with itself."""
    kinds = [np.int32] * 5 + [np.int64]

    def pairs(table, key, one, two, block, code) -> Iterator[pa.RecordBatch]:
        code = code.view(np.uint64)
        new = np.ones(len(code), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (table, key, one, two)])
        ends = np.append(np.flatnonzero(new), len(code))
        end = np.repeat(ends[1:], np.diff(ends))
        at = np.arange(len(code))
        step = 1
        while True:
            at = at[at + step < end[at]]
            if not len(at):
                break
            i, j = at, at + step
            near = (np.bitwise_count(code[i] ^ code[j]) <= budget) & ((one[i] == two[i]) | (block[i] != block[j]))
            i, j = i[near], j[near]
            sub = [_substring(code[k], table[i]) for k in (i, j)]
            here = _meeting_here(*sub, key[i].astype(np.uint64))
            if here.any():
                a, b = code[i[here]].view(np.int64), code[j[here]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, k) for k in kinds]
        for b in batches:
            held = [np.concatenate((h, b.column(k).to_numpy(zero_copy_only=False))) for k, h in enumerate(held)]
            if not len(held[0]):
                continue
            last = int(np.argmax(np.logical_and.reduce([h == h[-1] for h in held[:4]])))  # sorted: the last bucket may go on in the next batch
            if last:
                yield from pairs(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        if len(held[0]):
            yield from pairs(*held)

    dealt = rows.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET).select(*_BUCKET, "block", "code")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_codes(codes: DataFrame, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``u, v`` (u < v): distinct codes (rows ``code``) that meet in a table and differ in at most ``budget`` bits."""
    every = _spread(codes)
    sizes = stage(every.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "code-buckets")
    zero = F.lit(0)
    fits = every.join(sizes.where(F.col("n") <= bucket_rows).drop("n"), ["table", "key"], "left_semi")
    rows = fits.select("table", "key", zero.alias("one"), zero.alias("two"), zero.alias("block"), "code")
    large = sizes.where(F.col("n") > bucket_rows)
    if not large.isEmpty():
        blocks = F.ceil(F.col("n") / bucket_rows).cast("int")
        mine = every.join(large, ["table", "key"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
        mine = mine.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        rows = rows.unionByName(mine.select("table", "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "code"))
    return stage(_bucket_pairs(rows, budget), "near-codes")


def _judged(pairs: DataFrame, kind: np.dtype, cosine: float) -> DataFrame:
    """``a, b, whole``: pairs of cells that link in all members (true) or may link in some (false)."""
    widest = np.arccos(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                b = whole.slice(k, 2048)
                cos, angle = _angles(b.column("x").to_pylist(), b.column("y").to_pylist(), kind)
                reach = b.column("r").to_numpy() + b.column("s").to_numpy()
                points = reach == 0
                every = np.where(points, cos >= cosine, angle + reach <= widest - _SLACK)
                some = ~points & ~every & (angle - reach <= widest + _SLACK) & (cos > -1)
                keep = pa.array(every | some)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(every)], names=["a", "b", "whole"]).filter(keep)

    return pairs.select("a", "b", "x", "y", "r", "s").mapInArrow(run, "a binary, b binary, whole boolean")


def _counted(pairs: DataFrame, kind: np.dtype, cosine: float) -> DataFrame:
    """``a, b, key, links``: the links of each member of one cell with a block of the other, from rows ``a, b, p, q`` (arrays of members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            out: list[tuple] = []
            for k in range(whole.num_rows):
                r = whole.slice(k, 1).to_pylist()[0]
                x, y = (_units([m["vec"] for m in r[c]], kind) for c in ("p", "q"))
                hit = x @ y.T >= cosine
                edge = np.abs(x @ y.T - cosine) < 1e-12  # as for single pairs, whose sums run in another order
                for i, j in zip(*np.nonzero(edge), strict=True):
                    hit[i, j] = (x[i] * y[j]).sum() >= cosine
                for side, other, links in (("p", "q", hit), ("q", "p", hit.T)):
                    n = links @ np.array([m["mult"] for m in r[other]], np.int64)
                    out += [(r["a"], r["b"], m["key"], int(c)) for m, c in zip(r[side], n, strict=True) if c]
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kinds[c]) for c in range(4)], names=["a", "b", "key", "links"])

    return pairs.select("a", "b", "p", "q").mapInArrow(run, "a binary, b binary, key binary, links long")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS, column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each row of ``rows``."""
    kind = np.dtype("<f4" if isinstance(rows.schema[column].dataType.elementType, T.FloatType) else "<f8")
    every = stage(_vector_rows(rows, column), "vectors")
    distinct = stage(every.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"), F.first("vec").alias("vec")), "distinct-vectors")
    lone = every.select("vec_id", "key").where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if distinct.isEmpty():
        return lone
    coded = stage(_with_codes(distinct, _fit(distinct, kind, sample), kind), "coded-vectors")
    members = stage(_members(coded, kind, cosine), "cell-members")
    cells = members.groupBy("cell").agg(F.first("code").alias("code"), F.sum("mult").alias("n"), F.count(F.lit(1)).alias("size"), F.max("radius").alias("radius"), F.min("least").alias("least"))
    cells = stage(cells.join(coded.select(F.col("key").alias("k"), "vec"), F.col("cell") == F.col("k")).drop("k"), "cells")

    by_code = cells.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    codes = near_codes(by_code.select("code"), budget, bucket_rows).unionByName(by_code.where("n > 1").select(F.col("code").alias("u"), F.col("code").alias("v")))
    left = cells.select(F.col("code").alias("u"), F.col("cell").alias("a"), F.col("vec").alias("x"), F.col("radius").alias("r"))
    right = cells.select(F.col("code").alias("v"), F.col("cell").alias("b"), F.col("vec").alias("y"), F.col("radius").alias("s"))
    pairs = codes.join(left, "u").join(right, "v").where("u <> v or a < b")
    judged = stage(_judged(pairs, kind, cosine), "cell-pairs")

    partly = judged.where("not whole").select("a", "b")
    met = partly.select(F.col("a").alias("cell")).unionByName(partly.select(F.col("b").alias("cell"))).distinct()
    block = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK).cast("long"))
    blocks = members.join(met, "cell", "left_semi").join(cells.select("cell", "size"), "cell").join(coded.select("key", "vec"), "key")
    blocks = stage(blocks.groupBy("cell", block.alias("block")).agg(F.collect_list(F.struct("key", "mult", "vec")).alias("m")).drop("block"), "cell-blocks")
    crossed = partly.join(blocks.select(F.col("cell").alias("a"), F.col("m").alias("p")), "a").join(blocks.select(F.col("cell").alias("b"), F.col("m").alias("q")), "b")
    counted = stage(_counted(crossed, kind, cosine).groupBy("a", "b", "key").agg(F.sum("links").alias("links")), "member-links")

    whole = judged.where("whole")
    size = cells.select("cell", "n")
    totals = whole.join(size.withColumnRenamed("cell", "b"), "b").select(F.col("a").alias("cell"), "n").unionByName(whole.join(size.withColumnRenamed("cell", "a"), "a").select(F.col("b").alias("cell"), "n"))
    totals = totals.groupBy("cell").agg(F.sum("n").alias("others"))
    edges = whole.select("a", "b").unionByName(counted.select("a", "b").distinct()).select(F.hex("a").alias("u"), F.hex("b").alias("v"))
    parts = stage(components(edges), "components")
    placed = cells.select("cell", "n", "least").join(parts, F.hex("cell") == F.col("node"), "left").withColumn("part", F.coalesce("component", F.hex("cell")))
    named = placed.join(placed.groupBy("part").agg(F.min("least").alias("component_id")), "part").join(totals, "cell", "left")
    facts = named.select("cell", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links_of_cell"), "component_id")
    more = counted.groupBy("key").agg(F.sum("links").alias("more"))
    of_key = members.select("key", "cell").join(facts, "cell").join(more, "key", "left").select("key", (F.col("links_of_cell") + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    linked = every.where("key is not null").select("vec_id", "key").join(of_key, "key")
    return linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(lone)
