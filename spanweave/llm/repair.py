"""Conversation structure repair: the cheapest edits that make the turns' roles follow a grammar.

The roles' initials must read ``(s?(ua)+)?``.  Edits of a turn and their costs: Keep 0, Rerole to user or assistant 1, Delete 2 (required
for blank and repeated turns); Insert an empty turn 5; an undeleted truncated turn adds 5.  Of all cheapest edits the ASCII-least audit (their initials in order) is taken.

Cost layers.  Before each turn, layer c is the set of grammar states (four bits) from which the rest can be finished at cost c.  All layers are one
word, four bits a layer, so that an edit of cost c is a shift by 4c for all layers at once, and a turn is a handful of bit operations.  No two states'
costs differ by more than 10 (an insertion or two, or deleting what a system turn would have been, leads from any state to any other), so twelve layers over a base hold
all.  The first layer that holds the start state gives the cost; the bit-trace from there takes, in ASCII order, the first edit that stays on a cheapest path.

Conversations of any length are spread: turns are dealt by range of (conversation, turn), so a long one lies in many tasks, and cut into chunks of ``CHUNK`` turns.
1. Each chunk gives a 4 x 4 table: the cheapest cost from each state at its begin to each at its end (min, +).
2. A stream over the tables, from the last chunk back, gives the costs at the end of each chunk.
3. Each chunk traces the edits for its four possible first states.
4. A stream over the chunks, from the first on, picks the state in which each begins, and so its edits.
Steps 2 and 4 read one row for each chunk and hold one.  Only the audit string and the SHA-256 of ``digest``, both of a whole conversation, pass one task for each conversation, as streams.

Defined results
* turns are taken by number (nulls first), then role and MD5 of the text; equal rows lie together and all but the first are repeats;
* ``damage`` reads a null conversation id, turn, role or text as one space; the id in the results stays null, one conversation of its own;
* an empty role has no initial, fits no state and is not legal beside another; initials are told by case;
* conversations without turns: zeros, an empty audit; an empty table gives an empty result; extra columns are left alone;
* a gap count beyond the range of a long is cut to the greatest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

#: Turns of a chunk.
CHUNK = 512
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)  # after nothing, a system turn, a user turn, an assistant turn
#: A turn's kind: its role's initial (a state, or 0 for any other) plus 4 if it is truncated and 8 if it must go.
CUT, GONE = 4, 8
_LAYERS = 12
_ONES = (1 << 4 * _LAYERS) // 15  # a bit for each layer
_BAND = _ONES * 15
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what a rerole or an insertion gives


def damage(rows: DataFrame) -> DataFrame:
    """Test damage of ``conv_id, turn, role, text`` by crc32 of ``conv_id:turn``: drops, empties, cuts ends, repeats, changes roles."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *named, (F.crc32(key) % 20).alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _pred(word: int, state: int) -> int:
    """The states, in each layer, from which a turn of this initial leads into a state of the layer."""
    into = word >> state & _ONES
    return into if state == SYSTEM else into << USER if state == ASSISTANT else into | into << SYSTEM | into << ASSISTANT


def _inserted(word: int) -> int:
    for _ in range(2):  # a third insertion in a row leads nowhere new
        word |= (_pred(word, USER) | _pred(word, ASSISTANT)) << 4 * INSERT & _BAND
    return word


def _settled(word: int, base: int) -> tuple[int, int]:
    while word and not word & 15:
        word, base = word >> 4, base + 1
    return word, base


class Layers:
    """The words before each turn of a run of kinds, from its end back; steps already seen are looked up."""

    _steps: dict[tuple[int, int], tuple[int, int]] = {}

    def __init__(self, kinds: bytes, copies: list[int], end: list[int | None]) -> None:
        least = min(c for c in end if c is not None)
        word, base = 0, least
        for state, cost in enumerate(end):
            if cost is not None and cost - least < _LAYERS:
                word |= 1 << state + 4 * (cost - least)
        self.words, self.bases = [word], [base]
        for kind, n in zip(reversed(kinds), reversed(copies), strict=True):
            found = self._steps.get((word, kind))
            if found is None:
                found = self._steps[word, kind] = self._step(word, kind)
            word, base = found[0], base + found[1] + DELETE * (n - 1)
            self.words.append(word)
            self.bases.append(base)
        self.words.reverse()
        self.bases.reverse()

    @staticmethod
    def _step(word: int, kind: int) -> tuple[int, int]:
        out = word << 4 * DELETE
        if not kind & GONE:
            more = TRUNCATED if kind & CUT else 0
            out |= (_pred(word, USER) | _pred(word, ASSISTANT)) << 4 * (REROLE + more)
            if kind & 3:
                out |= _pred(word, kind & 3) << 4 * more
        low, base = _settled(out, 0)  # the band starts at the least cost
        return _inserted(low & _BAND), base

    def cost(self, at: int, state: int) -> int | None:
        layers = self.words[at] >> state & _ONES
        return None if not layers else self.bases[at] + ((layers & -layers).bit_length() - 1) // 4

    def trace(self, kinds: bytes, copies: list[int], state: int) -> tuple[str, int]:
        """The ASCII-least edits from a state at the begin, and the state at the end."""
        out: list[str] = []
        for at, (kind, n) in enumerate(zip(kinds, copies, strict=True)):
            rest = DELETE * (n - 1)
            while True:
                left = self.cost(at, state)
                more = TRUNCATED if kind & CUT else 0
                after = self.cost(at + 1, state)
                if after is not None and left == DELETE + rest + after:
                    out.append("D" * n)
                    break
                if left == _plus(INSERT, self.cost(at, _NEXT[state])):
                    out.append("I")
                    state = _NEXT[state]
                    continue
                step = kind & 3
                fits = state == START if step == SYSTEM else step == _NEXT[state]
                if step and fits and left == _plus(more + rest, self.cost(at + 1, step)):
                    out.append("K")
                    state = step
                else:
                    out.append("R")
                    state = _NEXT[state]
                out.append("D" * (n - 1))
                break
        return "".join(out), state


def _plus(cost: int, rest: int | None) -> int | None:
    return None if rest is None else cost + rest


#: Costs after the last turn: nothing, or the insertions that end a pair.
_END = [0, 2 * INSERT, INSERT, 0]


def _kinds(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, kind, n``: equal rows counted, faults and initials told; all but digests of texts is left behind."""
    last = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    blank = F.length(last) == 0
    cut = ~F.substring(last, -1, 1).isin(".", "!", "?")
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), blank.alias("blank"), cut.alias("cut"))
    distinct = narrow.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    numbered = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = distinct.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(numbered).alias("first"))
    both = distinct.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    fault = F.when(F.col("blank") | (numbered > F.col("first")), GONE).when(F.col("cut"), CUT).otherwise(0)
    return both.select("conv_id", "turn", "role", "digest", "n", "blank", (kind + fault).cast("int").alias("kind"))


_CHUNK_TYPE = (
    "conv_id long, seg int, part int, turns array<long>, roles array<string>, digests array<binary>, copies array<long>, kinds binary, costs array<long>, "
    "blank long, duplicate long, truncated long, illegal long, n_turns long, low long, high long, last long, first_kind int, last_kind int"
)


def _pair_ok(a: int, b: int) -> bool:
    return (a & 3, b & 3) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _chunk(conv: int | None, seg: int, part: int, rows: list[dict]) -> dict:
    kinds, copies = bytes(r["kind"] for r in rows), [r["n"] for r in rows]
    turns = [r["turn"] for r in rows]
    known = [t for t in turns if t is not None]
    ends = [Layers(kinds, copies, [0 if t == end else None for t in range(4)]) for end in range(4)]
    cut = [r for r in rows if r["kind"] & CUT]
    gone = [r for r in rows if r["kind"] & GONE and not r["blank"]]
    return {
        "conv_id": conv, "seg": seg, "part": part, "turns": turns, "roles": [r["role"] for r in rows], "digests": [r["digest"] for r in rows], "copies": copies, "kinds": kinds,
        "costs": [e.cost(0, s) for s in range(4) for e in ends],
        "blank": sum(r["n"] for r in rows if r["blank"]),
        # copies of a row whose first is none of these are repeats
        "duplicate": sum(r["n"] for r in gone) + sum(r["n"] - 1 for r in rows if not r["kind"] & GONE),
        "truncated": len(cut),
        "illegal": sum(n - 1 for n in copies) + sum(not _pair_ok(a, b) for a, b in zip(kinds, kinds[1:])),
        "n_turns": len(set(known)), "low": min(known, default=None), "high": max(known, default=None), "last": known[-1] if known else None, "first_kind": kinds[0], "last_kind": kinds[-1],
    }


def _table(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _stream(df: DataFrame, step, ddl: str) -> DataFrame:
    """``step(rows)`` over the rows (dicts) of each partition in order; it yields dicts.  One Arrow batch is held."""
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in step(r for b in batches for k in range(0, b.num_rows, 64) for r in b.slice(k, 64).to_pylist()):
            held.append(row)
            if len(held) >= 256:
                yield from _table(held, schema)
                held = []
        yield from _table(held, schema)

    return df.mapInArrow(run, ddl)


def _chunks(rows: DataFrame) -> DataFrame:
    def step(rows: Iterator[dict]) -> Iterator[dict]:
        for conv, mine in groupby(rows, lambda r: r["conv_id"]):
            held, part = [], 0
            for r in mine:
                held.append(r)
                if len(held) == CHUNK:
                    yield _chunk(conv, r["seg"], part, held)
                    held, part = [], part + 1
            if held:
                yield _chunk(conv, held[0]["seg"], part, held)

    order = ("conv_id", "turn", "role", "digest")  # nulls first
    dealt = _kinds(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return _stream(dealt.withColumn("seg", F.spark_partition_id()), step, _CHUNK_TYPE)


def _ends(chunks: DataFrame) -> DataFrame:
    """The costs at the end of each chunk, by the chunks after it."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        for conv, mine in groupby(rows, lambda r: r["conv_id"]):
            after = list(_END)
            for r in mine:
                yield {"conv_id": conv, "seg": r["seg"], "part": r["part"], "after": after}
                c = r["costs"]
                after = [min(c[4 * s + t] + after[t] for t in range(4) if c[4 * s + t] is not None) for s in range(4)]

    dealt = chunks.select("conv_id", "seg", "part", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg"), F.desc("part"))
    return _stream(dealt, step, "conv_id long, seg int, part int, after array<long>")


def _same_chunk(a: DataFrame, b: DataFrame) -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"]) & (a["seg"] == b["seg"]) & (a["part"] == b["part"])


_STATS = ("blank", "duplicate", "truncated", "illegal", "n_turns", "low", "high", "last", "first_kind", "last_kind", "costs")


def _traces(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """Each chunk's edits and last state for its four possible first states."""
    types = dict(x.split() for x in _CHUNK_TYPE.split(", "))

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            layers = Layers(r["kinds"], r["copies"], r["after"])
            found = [layers.trace(r["kinds"], r["copies"], s) if layers.cost(0, s) is not None else ("", s) for s in range(4)]
            yield {k: r[k] for k in ("conv_id", "seg", "part", *_STATS)} | {"audits": [a for a, _ in found], "exits": [e for _, e in found], "cost": layers.cost(0, START)}

    both = chunks.join(ends, _same_chunk(chunks, ends)).drop(ends["conv_id"], ends["seg"], ends["part"])
    return _stream(both, step, ", ".join(f"{k} {types[k]}" for k in ("conv_id", "seg", "part", *_STATS)) + ", audits array<string>, exits array<int>, cost long")


def _picked(traces: DataFrame) -> DataFrame:
    """Each chunk's edits; ``tail`` ends a conversation after its last chunk, where ``whole`` has its audit and counts."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        for conv, mine in groupby(rows, lambda r: r["conv_id"]):
            state, pieces, total, before = START, [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0), None
            low = high = last = cost = None
            mine = iter(mine)
            r = next(mine)
            while r:
                following = next(mine, None)
                audit, first = r["audits"][state], state
                state = r["exits"][state]
                if following is None and state == USER:
                    audit += "I"
                elif following is None and state == SYSTEM:
                    audit += "II"
                pieces.append(audit)
                for k in total:
                    total[k] += r[k]
                if before is None:
                    cost = r["cost"]
                else:
                    total["illegal"] += not _pair_ok(before, r["first_kind"])
                    total["n_turns"] -= last is not None and last == r["low"]
                before, last = r["last_kind"], r["last"] if r["last"] is not None else last
                low = r["low"] if low is None else low
                high = r["high"] if r["high"] is not None else high
                row = {"conv_id": conv, "seg": r["seg"], "part": r["part"], "state": first, "audit": audit, "whole": None}
                if following is None:
                    gaps = 0 if low is None else min(high - low + 1 - total["n_turns"], (1 << 63) - 1)
                    row["whole"] = {"gaps": gaps, "cost": cost, "audit": "".join(pieces)} | {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}
                yield row
                r = following

    dealt = traces.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "part")
    whole = "struct<gaps:long, blank:long, duplicate:long, truncated:long, illegal:long, cost:long, audit:string>"
    return _stream(dealt, step, f"conv_id long, seg int, part int, state int, audit string, whole {whole}")


class Repaired:
    """``edits``: chunks with their edits; ``turns``: what is left, with keys of the texts; ``summary``: a row for each conversation that has turns."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
        self.chunks = stage(_chunks(self.rows), "repair-chunks")
        self.edits = stage(_picked(_traces(self.chunks, _ends(self.chunks))), "repair-edits")
        self.summary = self.edits.where(F.col("whole").isNotNull()).select("conv_id", "whole.*")

    def turns(self) -> DataFrame:
        """``conv_id, seg, part, place, turn, role, text``: the repaired turns, in order of ``seg, part, place``."""

        def step(rows: Iterator[dict]) -> Iterator[dict]:
            for r in rows:
                state, at, left = r["state"], -1, 0
                for place, edit in enumerate(r["audit"]):
                    if edit != "I":
                        if not left:
                            at += 1
                            left = r["copies"][at]
                        left -= 1
                    if edit == "D":
                        continue
                    state = r["kinds"][at] & 3 if edit == "K" else _NEXT[state]
                    row = {"conv_id": r["conv_id"], "seg": r["seg"], "part": r["part"], "place": place, "turn": None, "role": _ROLES.get(state), "old": None, "digest": None}
                    if edit != "I":
                        row |= {"turn": r["turns"][at], "old": r["roles"][at], "digest": r["digests"][at]}
                    if edit == "K":
                        row["role"] = r["roles"][at]
                    yield row

        edits = self.edits.drop("whole")
        both = self.chunks.join(edits, _same_chunk(self.chunks, edits)).drop(edits["conv_id"], edits["seg"], edits["part"])
        left = _stream(both, step, "conv_id long, seg int, part int, place int, turn long, role string, old string, digest binary")
        texts = self.rows.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("o"), F.unhex(F.md5("text")).alias("d"), "text").dropDuplicates(["c", "t", "o", "d"])
        found = left.where("digest is not null").join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("old") == F.col("o")) & (F.col("digest") == F.col("d")))
        names = ["conv_id", "seg", "part", "place", "turn", "role", "text"]
        return found.select(*names).unionByName(left.where("digest is null").withColumn("text", F.lit("")).select(*names))


def repair(rows: DataFrame) -> Repaired:
    """Repairs ``conv_id, turn, role, text``."""
    return Repaired(rows)


def digest(repaired: Repaired, ids: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``ids``: counts, cost, audit and the SHA-256 of the repaired turns."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        for conv, mine in groupby(rows, lambda r: r["conv_id"]):
            h, sep = hashlib.sha256(), ""
            for r in mine:
                h.update(f"{sep}{r['role']}:{r['text']}".encode())
                sep = "\n"
            yield {"conv_id": conv, "repaired_sha256": h.hexdigest()}

    order = ("conv_id", "seg", "part", "place")
    shas = _stream(repaired.turns().repartition("conv_id").sortWithinPartitions(*order), step, "conv_id long, repaired_sha256 string")
    names = ids.select(F.col("conv_id").cast("long")).distinct()
    summary, shas = repaired.summary.withColumnRenamed("conv_id", "c"), shas.withColumnRenamed("conv_id", "h")
    out = names.join(summary, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
