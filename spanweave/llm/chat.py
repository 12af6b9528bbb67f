"""Chat formatting at token level.

Every turn becomes ``OPEN role CLOSE_ROLE text CLOSE_TURN``.  The four control marks are reserved ids beyond the
vocabulary; role and text are encoded apart as ordinary text and spliced between them, so no content can form a
control id.  Control strings inside content are escaped before encoding (a backslash before each, and before each
backslash), so the rendered string can be parsed back as well.  The loss mask is the running sum of +1 at the begin
and -1 at the end of each assistant text.

Conversations are streamed: turns are encoded where they lie, dealt by conversation and sorted by turn, and put out in
chunks of about ``CHUNK`` ids.  One conversation of any length needs memory for a chunk; only its digest is sequential.

Defined results
* null or empty text or role: empty; null conv_id: one conversation of its own; null turn: before all others;
* turns with equal numbers: by the MD5 of role, line end and text; repeated rows: repeated turns;
* an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE_ROLE, CLOSE_TURN = "### ", ": ", " </turn>\n"
CHUNK = 1 << 16
# A literal backslash, then every string that a reader of the rendered text would take for a mark.
_TEXT = re.compile(r"(\\|###|</turn>)")
_ROLE = re.compile(r"(\\|###|</turn>|:)")
_BACK = re.compile(r"\\(\\|###|</turn>|:)")
#: The split pattern of the public byte-level vocabulary (fixed value, as published with it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _TEXT).sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


class Format:
    """A vocabulary of ranks with the reserved ids after it."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.open, self.close_role, self.close_turn = first, first + 1, first + 2
        self.marks = {self.open: OPEN, self.close_role: CLOSE_ROLE, self.close_turn: CLOSE_TURN}

    def encode(self, text: str) -> list[int]:
        return self.coder.encode_ordinary(text)

    def decode(self, ids) -> str:
        return self.coder.decode(list(ids))


_FORMATS: dict[str, Format] = {}


def format_of(path: str) -> Format:
    if path not in _FORMATS:
        _FORMATS[path] = Format(path)
    return _FORMATS[path]


def encode_turns(rows: DataFrame, path: str) -> DataFrame:
    """``conv_id, turn, role_ids, ids, loss, tie`` for each row (``tie`` orders turns with equal numbers); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = format_of(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                roles = [r or "" for r in part.column(2).to_pylist()]
                ids = [f.encode(escape(t or "")) for t in part.column(3).to_pylist()]
                arrays = [
                    part.column(0), part.column(1),
                    pa.array([f.encode(escape(r, True)) for r in roles], pa.list_(pa.int32())),
                    pa.array(ids, pa.list_(pa.int32())), pa.array([r == "assistant" for r in roles], pa.bool_()), part.column(4),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "role_ids", "ids", "loss", "tie"])

    picked = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.unhex(F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))))).alias("tie"))
    return picked.mapInArrow(run, "conv_id long, turn long, role_ids array<int>, ids array<int>, loss boolean, tie binary")


def splice(f: Format, turns: list[tuple[list[int], list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of some turns."""
    ids: list[int] = []
    steps: list[tuple[int, int]] = []
    for role, text, loss in turns:
        ids += [f.open, *role, f.close_role]
        if loss:
            steps += [(len(ids), 1), (len(ids) + len(text), -1)]
        ids += text
        ids.append(f.close_turn)
    step = np.zeros(len(ids) + 1, np.int8)
    for at, by in steps:
        step[at] += by
    return np.array(ids, np.int32), np.cumsum(step[:-1], dtype=np.int8)


def assemble(rows: DataFrame, path: str) -> DataFrame:
    """``conv_id, chunk, ids, mask``: the formatted conversations, their chunks in order within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = format_of(path)
        here, turns, size, chunk = None, [], 0, 0

        def put() -> pa.RecordBatch:
            ids, mask = splice(f, turns)
            return pa.RecordBatch.from_arrays(
                [pa.array([here[0]], pa.int64()), pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))],
                names=["conv_id", "chunk", "ids", "mask"],
            )

        for b in batches:
            for k in range(b.num_rows):
                conv = (b.column(0)[k].as_py(),)
                if conv != here:
                    if turns:
                        yield put()
                    here, turns, size, chunk = conv, [], 0, 0
                elif size >= CHUNK:
                    yield put()
                    turns, size, chunk = [], 0, chunk + 1
                turns.append((b.column(2)[k].as_py(), b.column(3)[k].as_py(), b.column(4)[k].as_py()))
                size += len(turns[-1][0]) + len(turns[-1][1]) + 3
        if turns:
            yield put()

    dealt = encode_turns(rows, path).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    return dealt.mapInArrow(run, "conv_id long, chunk long, ids array<int>, mask array<tinyint>")


def parse(f: Format, ids: np.ndarray) -> Iterator[tuple[str, str]]:
    """Roles and texts, read back from ids."""
    opens, roles, ends = (np.flatnonzero(ids == m) for m in (f.open, f.close_role, f.close_turn))
    for a, b, c in zip(opens.tolist(), roles.tolist(), ends.tolist(), strict=True):
        yield unescape(f.decode(ids[a + 1 : b])), unescape(f.decode(ids[b + 1 : c]))


def masked_texts(f: Format, ids: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """The unescaped text of each run of the loss mask."""
    edge = np.diff(np.concatenate(([0], mask, [0])))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        yield unescape(f.decode(ids[a:b]))


def render(f: Format, ids: np.ndarray) -> str:
    """The conversation as one string, with the control strings in place of the reserved ids."""
    at = np.flatnonzero(ids >= f.open)
    out, last = [], 0
    for k in at.tolist():
        out += [f.decode(ids[last:k]), f.marks[int(ids[k])]]
        last = k + 1
    return "".join([*out, f.decode(ids[last:])])


def digest(chunks: DataFrame, path: str) -> DataFrame:
    """One row for each conversation, read back from its chunks (in order within a partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = format_of(path)
        here, state = None, None

        def row() -> list:
            n, turns, chars, loss, formatted = state
            return [here[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted]

        def batch(rows: list[list]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=names)

        for b in batches:
            done = []
            for k in range(b.num_rows):
                conv = (b.column(0)[k].as_py(),)
                if conv != here:
                    if state:
                        done.append(row())
                    here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = (b.column(c)[k].values.to_numpy() for c in (2, 3))
                for role, text in parse(f, ids):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for text in masked_texts(f, ids, mask):
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(render(f, ids))
            yield batch(done)
        if state:
            yield batch([row()])

    return chunks.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
