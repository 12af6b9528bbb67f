"""Conversation repair against a plain search over (turn, state) that keeps whole audits."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import __spark_entry__
import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import repair

from .conftest import make_talks, write

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    for r in rows:
        conv, turn, role, text = (" " if r[k] is None else r[k] for k in ("conv_id", "turn", "role", "text"))
        hit = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if hit == 1:
            text = ""
        elif hit == 2:
            text = re.sub("[.!?]", "", text)
        elif hit == 4:
            role = "user"
        for _ in range((hit != 0) + (hit == 3)):
            yield r["conv_id"], r["turn"], role, text


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        yield "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))


def plain(rows, flaws):
    """Least (cost, audit) and the repaired turns, by trying all edits of each turn in each state."""
    best = {"": (0, "", [])}

    def inserted(best):
        for _ in range(2):
            for s, (c, a, out) in list(best.items()):
                n = NEXT[s]
                new = (c + 5, a + "I", [*out, ({"u": "user", "a": "assistant"}[n], "")])
                best[n] = min(best.get(n, new), new)
        return best

    best = inserted(best)
    for (_, _, role, text), flaw in zip(rows, flaws, strict=True):
        after: dict = {}

        def put(s, new, after=after):
            after[s] = min(after.get(s, new), new)

        more = 5 if flaw == "truncated" else 0
        for s, (c, a, out) in best.items():
            put(s, (c + 2, a + "D", out))
            if flaw not in ("blank", "duplicate"):
                n = NEXT[s]
                put(n, (c + 1 + more, a + "R", [*out, ({"u": "user", "a": "assistant"}[n], text)]))
                i = role[:1]
                if i and (i == n or i == "s" and s == ""):
                    put(i, (c + more, a + "K", [*out, (role, text)]))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def want(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]]
    for row in damaged(rows):
        by[row[0]].append(row)
    out = {}
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        flaws = list(faults(mine))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, left = plain(mine, flaws) if mine else (0, "", [])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv] = (min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0, flaws.count("blank"), flaws.count("duplicate"), flaws.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(spark, folder):
    rows = __spark_entry__.queries()["op11_conversation_repair"](spark, str(folder)).collect()
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in rows}
    assert len(got) == len(rows)
    return got


def long_talk(n, conv=77):
    """One conversation over many chunks, with repeats, blanks, odd roles and turns of one number."""
    roles = ("user", "assistant", "user", "assistant", "system", "tool", "", "agent", None)
    return [{"conv_id": conv, "turn": k // 2 if k % 7 else k * 3, "role": roles[k * k % 11 % 9], "text": ("yes.", "no", None, f"text {k}.", f"text {k % 50}!", " ")[k * 5 % 13 % 6]} for k in range(n)]


def test_op11(spark, small):
    rows = make_talks()
    assert found(spark, small) == want(rows)


def test_sql(tmp_path):
    rows = make_talks() + long_talk(60) + long_talk(25, None)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{write(tmp_path, talks=rows)}/conversations.parquet'")
    got = {r[0]: r[1:] for r in db.sql(f"SELECT conv_id, {', '.join(NAMES)} FROM ({__spark_entry__.oracle_sql()['op11_conversation_repair']})").fetchall()}
    assert got == want(rows)


def test_op11_empty(spark, empty):
    assert found(spark, empty) == {}


@pytest.mark.parametrize("n,chunk", [(400, 3), (3000, 512), (61, 1)])
def test_long_conversations_are_cut_without_a_seam(spark, tmp_path, monkeypatch, n, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = long_talk(n) + long_talk(90, None) + [{"conv_id": 5, "turn": -(2**63), "role": "user", "text": "a."}, {"conv_id": 5, "turn": 2**62, "role": "assistant", "text": "b."}] + [{"conv_id": 6, "turn": 1, "role": "user", "text": "again."}] * 900
    assert found(spark, write(tmp_path, talks=rows)) == want(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", "blank", "duplicate", "truncated"])), max_size=14))
def test_layers_give_the_cost_and_the_least_audit(turns):
    rows = [(0, k, role, str(k)) for k, (role, _) in enumerate(turns)]
    flaws = [f for _, f in turns]
    kinds = bytes({"s": 1, "u": 2, "a": 3}.get(r[:1], 0) + (8 if f in ("blank", "duplicate") else 4 if f == "truncated" else 0) for r, f in turns)
    layers = repair.Layers(kinds, [1] * len(kinds), repair._END)
    audit, state = layers.trace(kinds, [1] * len(kinds), repair.START)
    audit += {repair.USER: "I", repair.SYSTEM: "II"}.get(state, "")
    cost, least, _ = plain(rows, flaws)
    assert (layers.cost(0, repair.START), audit) == (cost, least)
