"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search runs over the lattice of a model's pieces.  It keeps a window of some times the ``longest piece`` of positions with
their backpointers; whenever all surviving paths pass through one boundary, the pieces before it are final and their ids
are committed, so a text of any length needs memory for the window (and its ids) only.  All text goes through this search.

* Unigram models: the path with the highest sum of scores survives at each position (ties: the longer last piece).
* BPE models: a path may go on with a piece only if the merges of the two pieces' text give just these two pieces
  (checked once for each pair and remembered).  One path survives at each position, and it is the one that the merge
  procedure takes; sums of scores would give other ids than the model's own.

Boundaries that no piece crosses (here: before a white-space mark that follows another character, and around
characters that are in no longer piece) are converged on by construction; the stretches between them are remembered in a bounded table.

Characters that the model does not have become byte pieces.  So do literal U+2581 marks, which the model uses for a space: decoding gives
back the text code point for code point.

Defined results
* null text: null ids, 0 tokens, decoded null; empty text: no ids; white space is kept;
* very long texts and words: besides the text itself memory grows with the packed ids (4 bytes each), pieces of ``CHARS`` characters are handled at once;
* repeated rows, ties: equal texts give equal ids;
* empty tables give empty results; extra columns are kept by ``encode``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import quoted, wider

SPACE = "▁"
#: Entries of a table of remembered stretches (two are kept, a new and an old one) and of checked pairs.
REMEMBER, PAIRS = 220_000, 200_000
#: Characters (about) and ids that are handled at once.
CHARS, IDS = 1 << 20, 1 << 16
#: Positions between two looks for a common boundary, in lengths of the longest piece.
WINDOW = 4


def _wire(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = b[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, b[i : i + n]
            i += n


class PieceModel:
    """A SentencePiece model file: pieces, scores, kind (1 unigram, 2 BPE), and the search over them."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.prefix = 1, True
        for field, value in _wire(sp.serialized_model_proto()):
            if field == 2:
                self.kind = dict(x for x in _wire(value) if x[0] == 3).get(3, 1)
            if field == 3:
                spec = dict(_wire(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(1, b"identity") != b"identity" or spec.get(4, 1):
                    raise ValueError("only models that leave the text as it is (identity normaliser, white space kept) can be decoded exactly")
        n = len(sp)
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score = {p: sp.get_score(i) for i, p in enumerate(self.pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.packed = {p: np.int32(i).tobytes() for i, p in enumerate(self.pieces) if p in self.score}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        bytes_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.raw = [bytes_of.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces")
        self.mark = np.array([self.byte_id[b] for b in SPACE.encode()], np.int32).tobytes()  # a literal mark
        self.longest = max(map(len, self.score))
        #: The pieces by their characters: a node is its children, and the piece that ends there or None.
        self.trie: tuple[dict, str | None] = ({}, None)
        for piece in self.score:
            node = self.trie
            for c in piece[:-1]:
                node = node[0].setdefault(c, ({}, None))
            end = node[0].get(piece[-1])
            node[0][piece[-1]] = (end[0] if end else {}, piece)
        self.lowest = min(self.score.values()) - 10.0
        inside = {(a, b) for p in self.score for a, b in zip(p, p[1:], strict=False)}
        joined = {c for pair in inside for c in pair}
        # no piece goes from another character to a mark: a stretch is marks, then other characters
        self.marks_first = all(a == SPACE for a, b in inside if b == SPACE)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        body = f"[^{SPACE}{alone}]"
        lone = f"|[{alone}]" if alone else ""
        self.stretch = re.compile(f"{SPACE}*{body}+|{SPACE}+{lone}" if self.marks_first else r"(?s).+")
        self.begin = re.compile(f"[^{SPACE}]{SPACE}")
        self._pairs: dict[str, dict[str, bool]] = {}
        self._n_pairs = 0
        self._known: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _merge(self, text: str) -> list[str]:
        """The merge procedure itself, for short texts: join the best-scored neighbours, leftmost first, until none is a piece."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, a: str, b: str) -> bool:
        """Whether the merges leave ``b`` beside ``a``; remembered by ``a``."""
        if self._n_pairs >= PAIRS:
            self._pairs.clear()
            self._n_pairs = 0
        self._n_pairs += 1
        fits = self._pairs.setdefault(a, {})[b] = self._merge(a + b) == [a, b]
        return fits

    def _packed_of(self, piece: str) -> bytes:
        return self.packed.get(piece) or np.array([self.byte_id[b] for b in piece.encode()], np.int32).tobytes()

    def search(self, text: str) -> Iterator[str]:
        """Pieces of ``text`` (spaces already marked), each given out once every surviving path goes through its end."""
        return self._by_merges(text) if self.kind == 2 else self._by_scores(text)

    @staticmethod
    def _boundary(length: list[int], begin: int, end: int) -> int:
        """Where the paths to the positions from ``begin`` to ``end`` that are reached (``length`` of their last pieces) meet; 0: not behind the window's start."""
        paths = {p for p in range(begin, end) if length[p]}
        while len(paths) > 1:
            p = max(paths)
            paths.discard(p)
            paths.add(p - length[p])
            if 0 in paths:
                return 0
        return paths.pop() if paths else 0

    @staticmethod
    def _path(length: list[int], to: int) -> list[int]:
        """The lengths of the pieces from the window's start to a position."""
        out = []
        while to:
            out.append(length[to])
            to -= length[to]
        return out[::-1]

    def _by_merges(self, text: str) -> Iterator[str]:
        n, longest, root, pairs, fits_now = len(text), self.longest, self.trie[0], self._pairs, self._fits
        wide, unknown = WINDOW * longest, {}
        base, before = 0, ""  # the window's start, and the last piece that was committed
        length = [0] * (min(n, wide + longest) + 1)
        last = [""] * len(length)  # the piece that ends at each position
        for i in range(n):
            at = i - base
            left = last[at] or before
            beside = pairs.get(left, unknown).get
            children, to = root, at
            for c in text[i : i + longest]:
                node = children.get(c)
                to += 1
                if node is None:
                    if to > at + 1:
                        break
                    piece = c  # no piece begins so: the character alone
                else:
                    children, piece = node
                    if piece is None and to == at + 1:
                        piece = c
                if piece is not None and not length[to]:
                    if left:
                        fits = beside(piece)
                        if fits if fits is not None else fits_now(left, piece):
                            length[to], last[to] = to - at, piece
                    else:
                        length[to], last[to] = to - at, piece
                if node is None or not children:
                    break
            if at + 1 == wide and i + 1 < n:
                # the paths that can go on end behind position i
                meet = self._boundary(length, at + 1, min(len(length), at + 1 + longest))
                for size in self._path(length, meet):
                    before = text[base : base + size]
                    yield before
                    base += size
                if not meet:  # no common boundary yet: the window grows until there is one
                    wide += longest
                more = min(meet or longest, n - base - len(length) + meet + 1)
                length, last = length[meet:] + [0] * more, last[meet:] + [""] * more
                if meet:
                    length[0], last[0] = 0, ""
                    wide = max(WINDOW * longest, i + 2 - base)
        for size in self._path(length, n - base):
            yield text[base : base + size]
            base += size

    def _by_scores(self, text: str) -> Iterator[str]:
        n, longest, score, lowest = len(text), self.longest, self.score, self.lowest
        wide, base = WINDOW * longest, 0
        length, total = [0] * (min(n, wide + longest) + 1), [0.0] * (min(n, wide + longest) + 1)
        for i in range(n):
            at = i - base
            children = self.trie[0]
            for k, c in enumerate(text[i : i + longest], 1):
                node = children.get(c)
                piece = node[1] if node else None
                if piece is not None or k == 1:
                    s = total[at] + (lowest if piece is None else score[piece])
                    if not length[at + k] or s > total[at + k]:
                        total[at + k], length[at + k] = s, k
                if node is None:
                    break
                children = node[0]
            if at + 1 == wide and i + 1 < n:
                meet = self._boundary(length, at + 1, min(len(length), at + 1 + longest))
                for size in self._path(length, meet):
                    yield text[base : base + size]
                    base += size
                more = min(meet or longest, n - base - len(length) + meet + 1)
                length, total = length[meet:] + [0] * more, total[meet:] + [0.0] * more
                if meet:
                    length[0] = 0
                    wide = max(WINDOW * longest, i + 2 - base)
                else:
                    wide += longest
        for size in self._path(length, n - base):
            yield text[base : base + size]
            base += size

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def encode_packed(self, text: str) -> bytes:
        """The ids as packed 32-bit integers."""
        if not text:
            return b""
        out: list[bytes] = []
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append(self.mark)
                if not part:
                    continue
            marked = (SPACE if self.prefix and not k else "") + part.replace(" ", SPACE)
            at = 0
            while at < len(marked):
                cut = self.begin.search(marked, at + CHARS) if self.marks_first else None  # a stretch begins there
                end = cut.start() + 1 if cut else len(marked)
                stretches = self.stretch.findall(marked, at, end)
                found = list(map(self._known.get, stretches))
                if None in found:
                    for k, ids in enumerate(found):
                        if ids is None:
                            found[k] = self._learn(stretches[k])
                out.append(b"".join(found))
                at = end
        return b"".join(out)

    def _learn(self, stretch: str) -> bytes:
        ids = self._known.get(stretch)
        if ids is not None:
            return ids
        ids = self._old.get(stretch)
        if ids is None:
            ids = b"".join(self._packed_of(piece) for piece in self.search(stretch))
        if len(stretch) <= 64:
            if len(self._known) >= REMEMBER:  # what was not met again since the last turn goes
                self._old = dict(self._known)
                self._known.clear()
            self._known[stretch] = ids
        return ids

    def raw_parts(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of the text of ``ids``, some at once."""
        for lo in range(0, len(ids), IDS):
            raw = b"".join(map(self.raw.__getitem__, ids[lo : lo + IDS].tolist()))
            yield raw[1:] if self.prefix and not lo else raw

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.raw_parts(np.asarray(ids, np.int32))).decode()

    def decoded_sha256(self, packed: bytes) -> str:
        sha = hashlib.sha256()
        for raw in self.raw_parts(np.frombuffer(packed, np.int32)):
            sha.update(raw)
        return sha.hexdigest()


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model for each worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``docs`` with ``column`` (array of ids), ``n_tokens`` and ``decoded_sha256`` (of the text decoded from the ids) as last columns, instead of columns of these names."""
    added = (column, "n_tokens", "decoded_sha256")
    names = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = b.column(b.schema.names.index("text"))
            for lo in range(0, b.num_rows, 512):
                packed = [None if t is None else m.encode_packed(t) for t in texts.slice(lo, 512).to_pylist()]
                # decoded from the ids that are given out
                sha = [None if x is None else m.decoded_sha256(x) for x in packed]
                counts = np.array([len(x or b"") // 4 for x in packed], np.int64)
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), mask=np.array([*(x is None for x in packed), False]))
                ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(x or b"" for x in packed), np.int32)))
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), ids, pa.array(counts), pa.array(sha, pa.string())], names=[*names, *added])

    picked = docs.select(*map(quoted, names))
    return picked.mapInArrow(run, wider(picked.schema, **{column: T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "decoded_sha256": T.StringType()}))


def decode(rows: DataFrame, path: str, column: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text of ``column`` as last column ``to``."""
    names = [c for c in rows.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            texts = [None if i is None else m.decode(i) for i in b.column(b.schema.names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(texts, pa.string())], names=[*names, to])

    picked = rows.select(*map(quoted, names))
    return picked.mapInArrow(run, wider(picked.schema, **{to: T.StringType()}))
