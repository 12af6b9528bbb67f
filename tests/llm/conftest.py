from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
TALKS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])


def prose(r: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{int(r.paretovariate(0.6)) % vocabulary}" for _ in range(n)]
    return " ".join(w + (".\n" if r.random() < 0.08 else "") for w in words)


def make_docs() -> list[dict]:
    """Texts with copies, near copies, shared passages, junk, odd white space, nulls, an empty, a blank and a very long one."""
    r = random.Random(5)
    out: list[dict] = []

    def add(text, **more):
        i = len(out)
        out.append({"doc_id": i, "text": text, "lang": ("en", "de", None)[i % 3], "source": ("a", "b", "é", None)[i % 4], "n_chars": None if text is None else len(text)} | more)

    for _ in range(40):
        add(prose(r, r.randint(1, 300)))
    for i in range(8):
        add(out[i]["text"])
        words = out[i + 8]["text"].split(" ")
        words[len(words) // 2] = "changed"
        add(" ".join(words))
    passage = prose(r, 60)
    for _ in range(6):
        add(prose(r, 40) + " " + passage + "\t\n " + prose(r, 30))
    for k in range(20):
        add(" ".join(f"{w}{'###$$$&&&'[k % 9]}" for w in prose(r, 120).split()))
    for text in (None, "", " \n\t", "x", "one two", "a\x0bb\x0cc\x85d e f", "▁ a▁▁b ▁", "naïve ÀÉÎ ẞ İ", "😀 " * 50, "same same same " * 30, "line\nline\nline\n\n \nline"):
        add(text)
    add(prose(r, 60_000))
    out.append(dict(out[3]))  # a repeated row
    out.append(dict(out[4]) | {"text": "another text under an id that is there already " * 5})
    out.append({"doc_id": None, "text": out[5]["text"], "lang": None, "source": "a", "n_chars": 1})
    return out


def make_labels(docs: list[dict]) -> list[dict]:
    seen, out = set(), []
    for d in docs:
        if d["doc_id"] is not None and d["doc_id"] not in seen:
            seen.add(d["doc_id"])
            out.append({"doc_id": d["doc_id"], "quality": int(not any(c in (d["text"] or "") for c in "#$&")), "toxic": 0})
    return [*out, {"doc_id": 1, "quality": 0, "toxic": 1}, {"doc_id": None, "quality": 1, "toxic": 0}, {"doc_id": 2, "quality": None, "toxic": None}, {"doc_id": 10**9, "quality": 1, "toxic": 0}]


def make_pages() -> list[dict]:
    body = "<p>Some words of a main text that are long enough to be one.</p>"
    pages = [f"<html><body><nav><a href=/x>menu</a></nav><article><h1>T{i}</h1>{body * (i % 4)}</article><footer>foot</footer></body></html>" for i in range(12)]
    rows = [{"page_id": i, "url": f"http://e.org/{i} ü%\n", "html": h} for i, h in enumerate([*pages, *pages[:5], None, "", "", "plain & text &lt;", "<script>never ends", "<p>é" * 3000])]
    return [*rows, dict(rows[2]), {"page_id": None, "url": None, "html": pages[1]}, {"page_id": 99, "url": None, "html": None}]


def make_talks() -> list[dict]:
    rows = [{"conv_id": c, "turn": t, "role": ("system", "user", "assistant")[t % 3], "text": f"text {c} {t} ### </turn> \\"} for c in range(5) for t in range(6)]
    odd = [(7, 0, "user", None), (7, 1, None, "x"), (7, 1, "assistant", ""), (7, None, "assistant", "first"), (None, 0, "assistant", "no id"), (8, 0, "assistant", "a"), (8, 0, "assistant", "a"), (9, 0, "tool: ### x", "\\\\### Assistant: #### <</turn>\n</turn"), (10, 0, "assistant", "long " * 40_000)]
    rows += [dict(zip(("conv_id", "turn", "role", "text"), x, strict=True)) for x in odd]
    random.Random(1).shuffle(rows)
    return rows


def write(folder, docs=(), labels=(), pages=(), talks=(), vectors=()) -> str:
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("pages", pages, PAGES), ("conversations", talks, TALKS), ("embeddings", vectors, VECTORS)):
        pq.write_table(pa.Table.from_pylist(list(rows), schema), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def docs():
    return make_docs()


@pytest.fixture(scope="session")
def small(tmp_path_factory, docs):
    return write(tmp_path_factory.mktemp("small"), docs, make_labels(docs), make_pages(), make_talks())


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"))
