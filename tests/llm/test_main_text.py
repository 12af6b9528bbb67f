"""Main text: odd and very long pages, names as evidence, the fitted model, and labels by brute force."""

from __future__ import annotations

import itertools
import math
import time

import pytest

from spanweave.llm import mincut

LONG = "A text of the article with many words in it that is long enough."


@pytest.mark.parametrize("page,want", [
    (f'<div class="ad-free content"><h1>T</h1><p>{LONG}</p></div>', f"T\n\n{LONG}"),
    (f'<div class="story-share-free"><p>{LONG}</p></div>', LONG),
    (f'<div class="has-sidebar"><article><p>{LONG}</p></article><div class="sidebar"><p>{LONG}</p></div></div>', LONG),
    (f'<div class="ads"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n\n{LONG}"),  # all there is on the page
    (f'<div class="ads"><p>{LONG}</p></div><article><p>{LONG} B</p></article>', f"{LONG} B"),
    (f'<article><div class="article-header"><h1>Head</h1></div><p>{LONG}</p><div class="post-comments"><p>{LONG}</p></div></article>', f"Head\n\n{LONG}"),
    (f'<p class="x>{LONG}</p><p>{LONG}</p>', f"{LONG}\n\n{LONG}"),
    (f'<p title="a > b" data-x="<b>">{LONG}</p>', LONG),
    (f"<p title=it's>{LONG}</p><p>{LONG}'</p>", f"{LONG}\n\n{LONG}'"),
    (f"<p>{LONG}</p><p class=\"never ends", LONG),
    (f"<p>1 < 2 &amp; {LONG} &lt;b&gt;</p>", f"1 < 2 & {LONG} <b>"),
    (f"<svg/><article><p>{LONG}<select><option>x</article>", f"{LONG}x"),
    ("<html><head><title>T</title></head><body></body></html>", ""),
])
def test_pages(page, want):
    assert mincut.main_text(page) == want


@pytest.mark.parametrize("page", ["<div>word text ", '<a "', "<p x='\"", "<select>", "<!", "</", "<div><p>", "<script ", "a<"])
def test_long_odd_pages_take_linear_time(page):
    began = time.time()
    mincut.main_text(page * 50_000)
    assert time.time() - began < 20
    nested = "<div>" * 50_000 + "</section>" * 50_000 + f"<article><p>{LONG}"
    assert mincut.main_text(nested) == LONG


def test_fitted_model_on_other_templates():
    """Held-out accuracy, of the model alone and of the cut."""
    w = mincut.fitted()
    right = alone = total = 0
    for page in mincut.templates(120, seed=99):
        p = mincut.page_blocks(page)
        for b, yes in zip(p.blocks, mincut.label(p, w), strict=True):
            good = b.text.startswith("good")
            total += 1
            alone += (mincut.content_score(b, w) > 0) == good
            right += yes == good
    assert right / total > 0.97 and alone / total > 0.95


def test_labels_by_brute_force():
    w = mincut.fitted()
    several = 0
    for page in mincut.templates(40, seed=5):
        p = mincut.page_blocks(page)
        blocks = p.blocks[:11]
        path = []
        for b in blocks:
            at, way = b.node, []
            while at >= 0:
                way.append(at)
                at = p.parent[at]
            path.append(way[::-1])
        links = []
        for i in range(1, len(blocks)):
            k = sum(x == y for x, y in zip(path[i - 1], path[i], strict=False))
            d = len(path[i - 1]) + len(path[i]) - 2 * k
            if d <= mincut.REACH:
                links.append((i - 1, i, mincut.NEIGHBOUR / (1 + d)))
            before = [j for j in range(i) if p.parent[blocks[j].node] == p.parent[blocks[i].node]]
            if before and before[-1] != i - 1:
                links.append((before[-1], i, mincut.SIBLING))
        scores = [mincut.content_score(b, w) for b in blocks]

        def cost(side):
            return sum(abs(s) for s, x in zip(scores, side, strict=True) if (s > 0) != x) + sum(c for i, j, c in links if side[i] != side[j])

        got = mincut.label(mincut.Page(blocks, p.parent), w)
        best = min(cost(x) for x in itertools.product([False, True], repeat=len(blocks)))
        assert math.isclose(cost(got), best, abs_tol=1e-6)
        several += any(got) and not all(got)
    assert several > 10
