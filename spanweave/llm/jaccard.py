"""SimHash near-dedup of whole texts at a Jaccard similarity, confirmed exactly.

A text's set is that of its hashed ``shingle``-word runs (A-Z lower-cased); its fingerprint is the SimHash of the set.  Two texts are linked if the
sets' Jaccard similarity is ``least`` percent or more; groups are what links connect.

Fingerprints of such texts differ in up to ``BUDGET`` of 64 bits, too many for a trie of all fingerprints: nearly all pairs of nodes would stay within
that budget down to single texts.  So the tries are those of blocks that every pair of similar sets shares: with every set in one common
order, two sets share an element among the first ``n - ceil(least * n) + 1`` of each (prefix filter).

1. The order is by hash, but shingles that stand in many prefixes come last (any order is right; this one keeps blocks small).
2. The prefixes meet in blocks, one for each shingle; blocks of one text are dropped.
3. Two rounds make few pairs and join large groups: the first compares the middle text of each block (whose fingerprint is nearest to the block's majority)
   with the others, the second neighbours in the order of fingerprints.  Pairs are compared by their whole sets.
4. In each block the fingerprints' tries are walked against themselves with the Hamming budget (``simhash.Walk``).  Pairs are dropped if their sizes, the
   places of the shingle or the sets' bit tables (a bit that one set lacks is an element that it lacks) show that they share too little.  The others are not
   listed: they join the groups of their texts to a *family*, of which only a spanning forest leaves the task, and a pair of nodes of one family is given up.
5. Each family's sets meet once, in tiles of bounded size (two parts of the family by the hash of the text), where all pairs of different groups are compared;
   a forest of the links leaves the tile.  Similar sets are in one group or in one family, so no link is lost.

The budget is the only step that could lose a link: bits differ with a chance of acos(2 J / (1 + J)) / pi = 0.151 at J = 0.8 (at most 0.19 for
sets of a few shingles), so that more than 26 of 64 do for fewer than 1 pair in 200,000 at that similarity, and for none above 0.9 in practice.

Defined results
* null, empty or blank text: all one group; fewer words than a shingle: the whole sequence;
* null doc_id: the row stays only if its group has no id; of a group without ids one row stays;
* rows equal in id are cut to one; an empty table gives an empty result; extra columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import blocks, find_words, fresh, gram_hashes, quoted, stage, word_hashes
from .simhash import BITS, Walk, _Parts

SHINGLE, LEAST = 5, 80
#: Shingles that come last in the order (a bounded table), and in how many prefixes one must stand.
COMMON, COMMON_IN = 100_000, 8
#: Texts that a task remembers, to skip exact copies.
SEEN = 200_000
#: Differing bits of the fingerprints of similar texts, at most.
BUDGET = 26
#: Pairs of nodes that the walk takes at once: with this budget many stay, at each of 64 depths.
CHUNK = 1 << 13
#: Longs of a set's bit table.
SKETCH = 16
_TABLE = [f"b{k}" for k in range(SKETCH)]
#: Elements of sets in each of the two parts of a family that a tile compares, about.
TILE = 1 << 18
#: Pairs that a task puts out at once.
PAIRS = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sets(text: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a blank text has the one element 0."""
    for _, _, data, off in blocks(text):
        data = _LOWER[data]
        starts, ends, counts = find_words(data, off)
        h = word_hashes(data, starts, ends)
        at = 0
        for n in counts.tolist():
            yield np.unique(gram_hashes(h[at : at + n], min(n, shingle))) if n else np.zeros(1, np.uint64)
            at += n


def _prefixes(texts: DataFrame, common: np.ndarray, shingle: int, least: int) -> DataFrame:
    """``h, th, n, place``: the first elements of each set; those in ``common`` (sorted) come after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys = b.column(0).to_pylist()
            new = []
            for k, th in enumerate(keys):
                if th not in seen:
                    seen.add(th)
                    new.append(k)
            if len(seen) > SEEN:
                seen = set()
            out: list[list[np.ndarray]] = [[], [], [], []]
            for k, s in zip(new, _sets(b.column(1).take(pa.array(new, pa.int64())), shingle), strict=True):
                n = len(s)
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                    s = np.concatenate((s[~last], s[last]))
                m = n + least * n // -100 + 1
                for column, value in zip(out, (s[:m].view(np.int64), np.full(m, keys[k]), np.full(m, n), np.arange(m)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], names=["h", "th", "n", "place"])

    return texts.mapInArrow(run, "h long, th long, n long, place long")


def _each_bucket(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole buckets of rows sorted by the first column; several at once."""
    held = [np.zeros(0, np.int64)] * columns
    for b in batches:
        held = [np.concatenate((x, b.column(k).to_numpy(zero_copy_only=False))) for k, x in enumerate(held)]
        last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on in the next batch
        if last:
            yield tuple(x[:last] for x in held)
            held = [x[last:] for x in held]
    if len(held[0]):
        yield tuple(held)


def _shared(prefixes: DataFrame) -> DataFrame:
    """The rows of buckets with two texts at least, each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_bucket(batches, 4):
            h, th = rows[:2]
            rows = [x[np.concatenate(([True], (h[1:] != h[:-1]) | (th[1:] != th[:-1])))] for x in rows]
            same = rows[0][1:] == rows[0][:-1]
            keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], names=["h", "th", "n", "place"])

    return prefixes.repartition("h").sortWithinPartitions("h", "th").mapInArrow(run, "h long, th long, n long, place long")


def _set_fingerprint(elements: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed long; ties of a bit are zeros."""
    ones = np.unpackbits(elements.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(elements)).tobytes(), "big", signed=True)


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows dealt by block and sorted by unsigned fingerprint, whose order is that of the bits."""
    return rows.repartition("h").sortWithinPartitions("h", F.col("fp").bitwiseXOR(F.lit(-(1 << (BITS - 1)))))


def _cuts(h: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h))


def _fit(i: np.ndarray, j: np.ndarray, n: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """Whether sets that meet at these places of theirs may be similar enough."""
    ni, nj = n[i], n[j]
    most = np.minimum(ni - place[i], nj - place[j])  # elements that both can have from the shingle on
    return (100 * np.minimum(ni, nj) >= least * np.maximum(ni, nj)) & ((100 + least) * most >= least * (ni + nj))


def _tables_fit(i: np.ndarray, j: np.ndarray, n: np.ndarray, bits: np.ndarray, least: int) -> np.ndarray:
    """Whether the bit tables of sets leave them enough common elements."""
    lack_i, lack_j = (np.bitwise_count(bits[a] & ~bits[b]).sum(axis=1, dtype=np.int64) for a, b in ((i, j), (j, i)))
    return (100 + least) * np.minimum(n[i] - lack_i, n[j] - lack_j) >= least * (n[i] + n[j])


def _candidates(rows: DataFrame, least: int, pairs_of: Callable) -> DataFrame:
    """``u, v`` from rows ``h, th, n, place, part, fp``: pairs of a block, out of those that ``pairs_of`` makes, that are in different parts and may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, th, n, place, part, fp in _each_bucket(batches, 6):
            found: list[np.ndarray] = []
            size = 0
            for i, j in pairs_of(_cuts(h), th, fp.view(np.uint64), part):
                ok = (part[i] != part[j]) & _fit(i, j, n, place, least)
                i, j = i[ok], j[ok]
                if len(i):
                    found.append(np.stack((np.minimum(th[i], th[j]), np.maximum(th[i], th[j]))))
                    size += len(i)
                    if size > PAIRS:
                        yield _pairs(found)
                        found, size = [], 0
            if found:
                yield _pairs(found)

    return _by_block(rows).select("h", "th", "n", "place", "part", "fp").mapInArrow(run, "u long, v long").distinct()


def _walked(rows: DataFrame, least: int) -> DataFrame:
    """``u, v`` from rows ``h, th, n, place, part, fp`` and bit tables: parts, joined as the candidates of all blocks join them; a forest for each batch of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _, n, place, part, fp, *table in _each_bucket(batches, 6 + SKETCH):
            fp, bits = fp.view(np.uint64), np.stack(table, 1).view(np.uint64)
            parts, node = np.unique(part, return_inverse=True)
            families, forest, stale = _Parts(len(parts)), [], 0
            walk = Walk(fp, BUDGET, _cuts(h), node, CHUNK)
            for i, j in walk.pairs():
                ok = (walk.label[i] != walk.label[j]) & _fit(i, j, n, place, least)
                i, j = i[ok], j[ok]
                ok = _tables_fit(i, j, n, bits, least)
                for a, b in zip(node[i[ok]].tolist(), node[j[ok]].tolist(), strict=True):
                    if families.join(a, b):
                        forest.append((a, b))
                        stale += 1
                if stale > len(h) // 64:
                    walk.relabel(families.labels()[node])
                    stale = 0
            if forest:
                yield _pairs([np.sort(parts[np.array(forest, np.int64).T], axis=0)])

    return _by_block(rows).select("h", "th", "n", "place", "part", "fp", *_TABLE).mapInArrow(run, "u long, v long").distinct()


def _tile_links(th: np.ndarray, part: np.ndarray, side: np.ndarray, fp: np.ndarray, bits: np.ndarray, elements: np.ndarray, off: np.ndarray, least: int, within: bool) -> list[tuple[int, int]]:
    """Links between texts of different parts (and, if not ``within``, of different sides) of a tile: a spanning forest of the parts."""
    n = np.diff(off)
    order = np.lexsort((th, n))
    th, part, side, fp, bits, n, begin = th[order], part[order], side[order], fp[order], bits[order], n[order], off[:-1][order]
    ids = np.unique(elements, return_inverse=True)[1]
    held = np.zeros(len(elements), bool)
    label = np.unique(part, return_inverse=True)[1]
    upto = np.searchsorted(n, 100 * n // least, "right")  # larger sets have too many others
    links = []
    for i in range(len(th)):
        j = np.arange(i + 1, upto[i])
        ok = (label[j] != label[i]) & (np.bitwise_count(fp[j] ^ fp[i]) <= BUDGET)
        j = j[ok if within else ok & (side[j] != side[i])]
        j = j[_tables_fit(np.full(len(j), i), j, n, bits, least)]
        if not len(j):
            continue
        mine = ids[begin[i] : begin[i] + n[i]]
        held[mine] = True
        for k in range(0, len(j), 256):
            some = j[k : k + 256]
            first = np.cumsum(n[some]) - n[some]
            theirs = ids[np.arange(n[some].sum()) + np.repeat(begin[some] - first, n[some])]
            both = np.add.reduceat(held[theirs], first, dtype=np.int64)
            for x in some[(100 + least) * both >= least * (n[some] + n[i])].tolist():
                if label[x] != label[i]:
                    links.append((int(th[i]), int(th[x])))
                    label[label == label[x]] = label[i]
        held[mine] = False
    return links


def _family_links(members: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """``u, v``: links between the parts of each family, from rows ``family, part, th, n``."""

    def run(tile: pa.Table) -> pa.Table:
        columns = {c: tile.column(c).to_numpy() for c in ("th", "part", "side", "fp", *_TABLE)}
        lists = tile.column("elements").combine_chunks()
        off = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)))
        bits = np.stack([columns[c] for c in _TABLE], 1).view(np.uint64)
        within = tile.column("a")[0].as_py() == tile.column("b")[0].as_py()
        links = _tile_links(columns["th"], columns["part"], columns["side"], columns["fp"].view(np.uint64), bits, lists.flatten().to_numpy(zero_copy_only=False), off, least, within)
        return pa.table(list(np.sort(np.array(links, np.int64).reshape(-1, 2), axis=1).T), names=["u", "v"])

    sides = members.groupBy("family").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("sides"))
    dealt = members.join(sides, "family").withColumn("side", F.pmod(F.xxhash64("th"), F.col("sides")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.select("family", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "th", "part")
    return dealt.join(sets, "th").groupBy("family", "a", "b").applyInArrow(run, "u long, v long")


def _middles(cuts: np.ndarray, th: np.ndarray, fp: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The text nearest to its block's majority of bits with all others of the block that are within the budget: of copies of one text the least changed."""
    length = np.diff(cuts)
    block = np.repeat(np.arange(len(length)), length)
    bits = np.unpackbits(fp.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    most = np.packbits(2 * np.add.reduceat(bits, cuts[:-1]) > length[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    middle = np.lexsort((th, np.bitwise_count(fp ^ most[block]), block))[cuts[:-1]]
    centre = np.repeat(middle, length)
    i = np.flatnonzero(np.bitwise_count(fp ^ fp[centre]) <= BUDGET)
    yield i, centre[i]


def _neighbours(cuts: np.ndarray, th: np.ndarray, fp: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of different parts that follow each other in the order of their fingerprints, rotated by each of four numbers of bits."""
    block = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for by in (0, 16, 32, 48):
        turned = fp << np.uint64(by) | fp >> np.uint64(64 - by) if by else fp
        order = np.lexsort((turned, block))
        i, j = order[:-1], order[1:]
        near = (block[i] == block[j]) & (part[i] != part[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= BUDGET)
        yield i[near], j[near]


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])


def _confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    a = sets.select(F.col("th").alias("u"), F.col("elements").alias("a"))
    b = sets.select(F.col("th").alias("v"), F.col("elements").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("long")
    return pairs.join(a, "u").join(b, "v").where((100 + least) * both >= least * (F.size("a") + F.size("b"))).select("u", "v")


def _parted(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """``rows`` with the ``part`` of their text: its group so far, or itself."""
    if found is None:
        return rows.withColumn("part", F.col("th"))
    return rows.join(found.withColumnRenamed("node", "th"), "th", "left").withColumn("part", F.coalesce("component", "th")).drop("component")


def text_groups(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """``node, component`` for the texts (by 64-bit hash) that are linked to another."""
    texts = docs.select(F.xxhash64("text").alias("th"), "text")
    common = _prefixes(texts, np.zeros(0, np.uint64), shingle, least).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON_IN)
    rows = stage(common, "common-shingles").orderBy(F.col("n").desc(), "h").limit(COMMON).select("h").collect()  # COMMON rows at most
    common = np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))
    buckets = stage(_shared(_prefixes(texts, common, shingle, least)), "shingle-buckets")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = list(_sets(part.column(1), shingle))
                prints = pa.array([_set_fingerprint(s) for s in sets], pa.int64())
                table = np.zeros((len(sets), SKETCH), np.uint64)
                for i, s in enumerate(sets):
                    at = s % np.uint64(64 * SKETCH)
                    np.bitwise_or.at(table[i], (at // np.uint64(64)).astype(np.int64), np.uint64(1) << at % np.uint64(64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), prints, *(pa.array(x) for x in table.view(np.int64).T)], names=["th", "elements", "fp", *_TABLE])

    # each text once before its set is made: sets are larger than texts and are not shuffled here
    met = texts.join(buckets.select("th").distinct(), "th", "left_semi").dropDuplicates(["th"])
    sets = stage(met.mapInArrow(elements, f"th long, elements array<long>, fp long, {', '.join(f'{c} long' for c in _TABLE)}"), "shingle-sets")
    edges = found = None
    for pairs_of in (_middles, _neighbours):
        rows = buckets.join(_parted(sets.select("th", "fp"), found), "th")
        new = stage(_confirmed(stage(_candidates(rows, least, pairs_of), "candidates"), sets.select("th", "elements"), least), "near-pairs")
        edges = new if edges is None else edges.unionByName(new)
        found = stage(components(edges), "text-components")
    rows = buckets.join(_parted(sets.select("th", "fp", *_TABLE), found), "th")
    # only blocks with several parts are left to walk
    several = stage(rows.groupBy("h").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("h"), "blocks-to-walk")
    joined = stage(_walked(rows.join(several, "h", "left_semi"), least), "joined-parts")
    families = stage(components(joined), "families").select(F.col("node").alias("part"), F.col("component").alias("family"))
    members = stage(_parted(sets.select("th", F.size("elements").cast("long").alias("n")), found).join(families, "part"), "family-members")
    return stage(components(edges.unionByName(stage(_family_links(members, sets, least), "family-links"))), "text-components")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """Of each group of near copies the document with the smallest id, once; the columns of ``docs``."""
    names = docs.columns
    groups = text_groups(docs, **parameters)
    narrow = docs.select("doc_id", F.xxhash64("text").alias("th")).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
    # a blank text is like any other blank text, which is found by its set
    named = narrow.join(groups, narrow["th"] == groups["node"], "left").withColumn("part", F.coalesce("component", "th"))
    first = named.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "rows")).alias("x")).select("x.*")
    # an id that comes first in several groups names one document; rows without an id are each their own
    whole = first.where("none").unionByName(first.where("not none").groupBy("doc_id").agg(F.min(F.struct("th", "rows")).alias("y")).select(F.lit(False).alias("none"), "doc_id", "y.th", "y.rows"))
    key, th, n = fresh(docs, "kept_id", "kept_th", "kept_rows")
    chosen = stage(whole.select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("rows").alias(n)), "kept-texts")
    # the documents are shuffled once; equal rows (few) are cut to one
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[key]) & (F.xxhash64(docs["text"]) == chosen[th]))
    first_of_equal = F.row_number().over(Window.partitionBy("doc_id", th).orderBy(F.xxhash64(*[quoted(c) for c in names])))
    one = kept.where(F.col(n) == 1).unionByName(kept.where(F.col(n) > 1).withColumn(n, first_of_equal).where(F.col(n) == 1))
    return one.select(*[quoted(c) for c in names])
