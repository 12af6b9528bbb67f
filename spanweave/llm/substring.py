"""Substring dedup by repeated-phrase automata.

A *window* is ``width`` consecutive words of one document.  Every word that is covered by a window whose word
sequence also starts in a document with a smaller doc_id is removed.

1. Anchors.  The anchor of a window is the smallest hash among its runs of ``gram`` words: equal windows have equal
   anchors, and neighbours mostly share one.  Each text gives its anchors; those that stand in two different
   texts are recurring.  Exact copies of a text count as one text here, so a group of copies costs no more than its first member.
2. Phrases.  Runs of windows with a recurring anchor are cut out of the first document of each text, with their place.
   Equal phrases are one row with their smallest doc_id: a phrase confirms its windows.
3. Automata.  Anchors are dealt into shards of bounded size; the phrases of an anchor with more words than a shard are cut into single
   windows, which are dealt by their own hash.  A text's stretch that is a phrase of an earlier document is covered from end to end.  The other stretches are the
   first of their phrase: their windows can only be earlier in other phrases.  A shard's windows that stand in several phrases of different documents
   become one Aho-Corasick automaton over word numbers, and these stretches are streamed through it to locate every occurrence.
   Hashes of windows choose the windows, and leave out stretches without one.
   A shard with much text is streamed by several tasks, each with the shard's automaton.
4. The covered places go back to their documents; exact copies of an earlier document are covered from end to end.

Hashes only choose what is looked at; which words go is decided by comparing words.  (Two texts are taken for one if
64 bits of XXH64 and 64 bits of SHA-256 agree.)

Defined results
* null or blank text: no words, nothing removed; fewer words than a window: nothing removed;
* null doc_id: the row is neither earlier nor later than any other and keeps its words;
* repeated rows and rows that share a doc_id: no row is earlier than another of the same id, each is returned with the same treatment;
* an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, find_words, fresh, gram_hashes, join_small, quoted, stage, word_hashes

WIDTH, GRAM = 13, 5
#: Words of phrases that one automaton is made of, and words of text that one task streams through it, about.
SHARD_WORDS, STREAM_WORDS = 120_000, 4_000_000
ROWS = 5_000
#: Over so many partitions a group of exact copies is dealt.
SALTS = 16
#: A table of at most so many heavy anchors is broadcast.
BROADCAST_ANCHORS = 100_000


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("th"), F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long").alias("tl")]


def _window_anchors(h: np.ndarray, counts: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of a block: row, first word (in the block) and anchor."""
    first = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(len(counts)), counts)
    g = gram_hashes(h, gram)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    reach, low = 1, g
    span = width - gram + 1
    while reach < span:  # minimum over the next span grams, by doubling
        step = min(reach, span - reach)
        low = np.minimum(low[: len(low) - step], low[step:])
        reach += step
    ok = np.flatnonzero(np.arange(n) + width <= first[row[:n] + 1])
    return row[ok], ok, low[ok]


def _runs(row: np.ndarray, place: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Where a new run of windows begins: another row or anchor, or a gap."""
    if not len(row):
        return np.zeros(0, np.int64)
    new = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
    return np.flatnonzero(np.concatenate(([True], new)))


def _anchors(texts: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            th = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, off in blocks(b.column(1)):
                starts, ends, counts = find_words(data, off)
                row, place, anchor = _window_anchors(word_hashes(data, starts, ends), counts, width, gram)
                at = _runs(row, place, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(th[row[at] + lo])], names=["anchor", "th"])

    return texts.select(_text_key()[0], "text").mapInArrow(run, "anchor long, th long")


def _phrases(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """Rows ``doc_id, th, anchors, text`` -> the phrases (with place) whose anchors are in ``anchors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, lists = b.column(0), b.column(1), b.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends_of = np.cumsum([0, *(len(x) for x in lists)])
            for lo, hi, data, off in blocks(b.column(3)):
                starts, ends, counts = find_words(data, off)
                row, place, anchor = _window_anchors(word_hashes(data, starts, ends), counts, width, gram)
                first = np.concatenate(([0], np.cumsum(counts)))
                by_row = np.searchsorted(row, np.arange(len(counts) + 1))
                wanted = np.zeros(len(row), bool)
                for k in range(len(counts)):
                    s = slice(by_row[k], by_row[k + 1])
                    wanted[s] = np.isin(anchor[s], values[ends_of[lo + k] : ends_of[lo + k + 1]])
                row, place, anchor = row[wanted], place[wanted], anchor[wanted]
                at = _runs(row, place, anchor)
                n = np.diff(np.concatenate((at, [len(row)])))
                raw = data.tobytes()
                r, p = row[at], place[at]
                text = [b" ".join(raw[s:e].split()) for s, e in zip(starts[p].tolist(), ends[p + n + width - 2].tolist(), strict=True)]
                for i in range(0, len(at), ROWS):
                    s = slice(i, i + ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(r[s] + lo)), keys.take(pa.array(r[s] + lo)), pa.array(anchor[at][s].view(np.int64)), pa.array((p - first[r])[s].astype(np.int64)),
                            pa.array((n[s] + width - 1).astype(np.int64)), pa.array([x.decode() for x in text[s]], pa.string()),
                        ],
                        names=["doc_id", "th", "anchor", "place", "n", "phrase"],
                    )

    return texts.select("doc_id", "th", "anchors", "text").mapInArrow(run, "doc_id long, th long, anchor long, place long, n long, phrase string")


def _compile(windows: dict[tuple[int, ...], list[int]], width: int) -> ahocorasick.Automaton | None:
    # whole ids as objects: of STORE_INTS values the library gives back the low 32 bits only
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for w, (lo, hi) in windows.items():
        if lo < hi:  # in phrases first met in two documents
            machine.add_word(w, lo)
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def _window_hashes(phrases: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of an array of phrases, in order: row and hash."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, _, data, off in blocks(phrases):
        starts, ends, counts = find_words(data, off)
        h = gram_hashes(word_hashes(data, starts, ends), width)
        row = np.repeat(np.arange(len(counts)), counts)
        whole = row[: len(h)] == row[width - 1 :]
        rows.append(row[: len(h)][whole] + lo)
        hashes.append(h[whole])
    return np.concatenate(rows), np.concatenate(hashes)


class _Shard:
    """The phrases of a shard, and the automaton of the windows that phrases first met in different documents have in common."""

    def __init__(self, width: int) -> None:
        self.width, self.numbers, self.machine = width, {}, None
        self.phrases: list[str] = []
        self.first: dict[str, int] = {}
        self.hash, self.least = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] | None = []

    def add(self, phrases: list[str], lo: np.ndarray, row: np.ndarray, h: np.ndarray) -> None:
        """Phrases with their first document (those that were cut out of several may be equal), and row and hash of their windows."""
        self.held.append((len(self.phrases) + row, h))
        self.phrases += phrases
        for p, k in zip(phrases, lo.tolist(), strict=True):
            self.first[p] = min(self.first.get(p, k), k)

    def close(self) -> None:
        """Makes the automaton when all phrases are there."""
        if self.held is None:
            return
        held, self.held = self.held, None
        if not held:
            return
        row, h = (np.concatenate(x) for x in zip(*held, strict=True))
        lo = np.array([self.first[p] for p in self.phrases], np.int64)[row]
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        least = np.minimum.reduceat(lo[order], at)
        several = least < np.maximum.reduceat(lo[order], at)
        self.hash, self.least = h[order][at][several], least[several]
        known = np.flatnonzero(self._known(h)[1])
        begin = np.searchsorted(row, row[known])
        windows: dict[tuple[int, ...], list[int]] = {}
        here, ids, numbers = -1, (), self.numbers
        for k, i, low in zip(row[known].tolist(), (known - begin).tolist(), lo[known].tolist(), strict=True):
            if k != here:
                here, ids = k, tuple([numbers.setdefault(w, len(numbers) + 1) for w in self.phrases[k].split(" ")])
            w = ids[i : i + self.width]
            seen = windows.get(w)
            if seen is None:
                windows[w] = [low, low]
            else:
                seen[0], seen[1] = min(seen[0], low), max(seen[1], low)
        self.machine, self.phrases = _compile(windows, self.width), []

    def _known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash among those chosen, and whether it is there."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return at, self.hash[at] == h

    def to_stream(self, lo: np.ndarray, row: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Rows of text with a window whose hash an earlier document has too; ``row`` and ``h`` are those of their windows."""
        if self.machine is None:
            return np.zeros(0, np.int64)
        at, known = self._known(h)
        row, at = row[known], at[known]
        return np.unique(row[self.least[at] < lo[row]])


def _locate(rows: DataFrame, width: int) -> DataFrame:
    """Rows ``shard, part, kind, lo, th, place, phrase``, sorted with the phrases of a shard (kind 0) before its text (kind 1).

    Memory: one shard's phrases, windows and automaton, and a batch of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shard = None, _Shard(width)
        for b in batches:
            if not b.num_rows:
                continue
            out: list[np.ndarray] = []
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
            lo, th, place = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3, 6))
            phrases = b.column(6).to_pylist()
            row, h = _window_hashes(b.column(6), width)
            words = np.bincount(row, minlength=b.num_rows) + width - 1
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if (where := tuple(key[s, :2].tolist())) != here:
                    here, shard = where, _Shard(width)
                x, y = np.searchsorted(row, (s, e)).tolist()
                if key[s, 2] == 0:
                    shard.add(phrases[s:e], lo[s:e], row[x:y] - s, h[x:y])
                    continue
                shard.close()
                # here lo is the document's own id
                whole = np.array([shard.first[p] for p in phrases[s:e]], np.int64) < lo[s:e]
                w = s + np.flatnonzero(whole)
                out.append(np.stack((lo[w], th[w], place[w], place[w] + words[w])))
                some = np.zeros(b.num_rows, bool)
                some[s:e] = ~whole
                x += np.flatnonzero(some[row[x:y]])
                numbers, runs = shard.numbers, []
                for k in shard.to_stream(lo, row[x], h[x]).tolist():
                    own, runs_of = int(lo[k]), len(runs)  # covered words; matches come by their last word
                    for end, first in shard.machine.iter(tuple([numbers.get(w, 0) for w in phrases[k].split(" ")])):
                        if first < own:
                            if len(runs) > runs_of and end - width < runs[-1][2]:
                                runs[-1][2] = end + 1
                            else:
                                runs.append([k, end - width + 1, end + 1])
                if runs:
                    k, begin, end = np.array(runs, np.int64).T
                    out.append(np.stack((lo[k], th[k], place[k] + begin, place[k] + end)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate([np.zeros((4, 0), np.int64), *out], axis=1)], names=["doc_id", "th", "begin", "end"])

    return rows.mapInArrow(run, "doc_id long, th long, begin long, end long")


def _dealt(rows: DataFrame, heavy: DataFrame, shards: int, width: int) -> DataFrame:
    """Phrase rows with their ``shard``; those of heavy anchors are cut into windows (``place`` and ``n`` follow)."""
    marked = join_small(rows, heavy, "anchor", heavy.count() <= BROADCAST_ANCHORS, "left", ("phrase",))
    words = F.split("phrase", " ")
    windows = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - width), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, width), " ").alias("phrase")))
    cut = marked.where("heavy").withColumn("x", F.explode(windows)).withColumn("phrase", F.col("x.phrase")).withColumn("n", F.lit(width).cast("long"))
    if "place" in rows.columns:
        cut = cut.withColumn("place", F.col("place") + F.col("x.at"))
    both = marked.where("heavy is null").drop("heavy").withColumn("key", F.lit(None).cast("string")).unionByName(cut.withColumn("key", F.col("phrase")).drop("x", "heavy"))
    return both.withColumn("shard", F.pmod(F.xxhash64("anchor", "key", F.lit(7)), F.lit(shards))).drop("key")


def covered_places(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, th, tl, spans`` (arrays of begin and end word) and ``whole`` (covered from end to end) for the texts with words to remove."""
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    keyed = texts.where(F.col("doc_id").isNotNull())
    groups = stage(keyed.groupBy(*_text_key()).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "text-groups")
    seen = _anchors(keyed, width, gram)
    recurring = seen.groupBy("anchor").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("anchor")
    wanted = seen.join(recurring, "anchor", "left_semi").groupBy("th").agg(F.collect_set("anchor").alias("anchors"))
    wanted = stage(wanted.join(groups, "th").select(F.col("first").alias("doc_id"), "th", "tl", "anchors"), "recurring-anchors")
    # one row for each text: its first document
    firsts = keyed.select("doc_id", "text", *_text_key()).join(wanted, ["doc_id", "th", "tl"])
    once = stage(_phrases(firsts, width, gram), "phrases")
    phrases = once.groupBy("anchor", "phrase").agg(F.min("doc_id").alias("lo"), F.first("n").alias("n"))
    phrases = stage(phrases, "distinct-phrases")
    total = phrases.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    heavy = stage(phrases.groupBy("anchor").agg(F.sum("n").alias("words")).where(F.col("words") > SHARD_WORDS).select("anchor", F.lit(True).alias("heavy")), "heavy-anchors")
    once, phrases = (_dealt(rows, heavy, shards, width) for rows in (once, phrases))
    # one row for each shard: how many tasks its text needs
    load = once.select("shard", "n").groupBy("shard").agg(F.ceil(F.sum("n") / STREAM_WORDS).cast("int").alias("parts"))
    load = stage(load, "shard-loads")
    part = F.pmod(F.xxhash64("doc_id", "place"), F.col("parts")).cast("int").alias("part")
    text = once.join(load, "shard").select("shard", part, F.lit(1).alias("kind"), F.col("doc_id").alias("lo"), "th", "place", "phrase")
    made = phrases.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "lo", F.lit(0).cast("long").alias("th"), F.lit(0).cast("long").alias("place"), "phrase")
    rows = made.unionByName(text).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    spans = _locate(rows, width).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    found = wanted.select("doc_id", "th", "tl").join(spans, ["doc_id", "th"]).select("doc_id", "th", "tl", "spans", F.lit(False).alias("whole"))
    # later copies: narrow rows, joined by text
    many = groups.where(F.col("first") < F.col("last"))
    # a group of copies is dealt over several tasks; texts too short for a window are left out
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = keyed.where(F.length("text") >= 2 * width - 1).select("doc_id", *_text_key(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = copies.join(many, ["th", "tl", "salt"]).where(F.col("doc_id") > F.col("first")).distinct()
    copies = copies.select("doc_id", "th", "tl", F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("spans"), F.lit(True).alias("whole"))
    return stage(found.unionByName(copies), "covered")


def _spans_of(n: int, whole: bool | None, spans: list | None, width: int) -> list[tuple[int, int]]:
    if whole:
        return [(0, n)] if n >= width else []
    out: list[tuple[int, int]] = []
    for s in spans or ():
        b, e = s["begin"], s["end"]
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def _joined(docs: DataFrame, width: int, gram: int) -> tuple[DataFrame, str, str]:
    """``docs`` with the spans to cut and whether all of it goes, and the names of these two columns."""
    spans, whole, key, th, tl = fresh(docs, "cut_spans", "cut_whole", "cut_id", "cut_th", "cut_tl")
    cover = covered_places(docs.select("doc_id", "text"), width, gram)
    cover = cover.select(F.col("doc_id").alias(key), F.col("th").alias(th), F.col("tl").alias(tl), F.col("spans").alias(spans), F.col("whole").alias(whole))
    rows = docs.select("*", *[k.alias(n) for k, n in zip(_text_key(), (th + "_", tl + "_"), strict=True)])
    on = (rows["doc_id"].cast("long") == cover[key]) & (rows[th + "_"] == cover[th]) & (rows[tl + "_"] == cover[tl])
    return rows.join(cover, on, "left").drop(key, th, tl, th + "_", tl + "_"), spans, whole


def digest(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, n_spans``: what is left of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, removed, sha, n_spans = [], [], [], []
            for text, spans, whole in zip(b.column(1), b.column(2), b.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                cut = _spans_of(len(words), whole.as_py(), spans.as_py(), width)
                n_words.append(len(words))
                for s, e in reversed(cut):
                    del words[s:e]
                removed.append(n_words[-1] - len(words))
                n_spans.append(len(cut))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(n_spans, pa.int64())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"])

    rows, spans, whole = _joined(docs.select(F.col("doc_id").cast("long"), "text"), width, gram)
    return rows.select("doc_id", "text", spans, whole).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The documents with the covered words cut out of their texts (n_chars, if there, follows); untouched texts stay byte for byte.

    White space before a removed run goes with it; a document with no word left has the empty text.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans, whole in zip(b.column(0), b.column(1), b.column(2), strict=True):
                t = text.as_py()
                if t is not None and (whole.as_py() or spans.as_py()):
                    raw = np.frombuffer(t.encode(), np.uint8)
                    starts, ends, _ = find_words(raw, np.array([0, len(raw)]))
                    cut = _spans_of(len(starts), whole.as_py(), spans.as_py(), width)
                    left, at = [], 0
                    for s, e in cut:
                        left.append(raw[at : ends[s - 1] if s else 0].tobytes())
                        at = ends[e - 1] if s else (starts[e] if e < len(starts) else len(raw))
                    left.append(raw[at:].tobytes())
                    t = b"".join(left).decode()
                out.append(t)
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols["text"] = pa.array(out, pa.string())
            if "n_chars" in cols:
                old = b.column(b.schema.names.index("n_chars"))
                cols["n_chars"] = pa.array([v if a.equals(c) else len(c.as_py() or "") for v, a, c in zip(old.to_pylist(), b.column(0), cols["text"], strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    rows, spans, whole = _joined(docs, width, gram)
    rest = [c for c in names if c != "text"]
    return rows.select("text", spans, whole, *map(quoted, rest)).mapInArrow(run, docs.schema)
