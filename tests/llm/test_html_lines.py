"""Surge and dive points by their definition, line by line, and what a mark around the article does."""

from __future__ import annotations

import random

from readloom.llm import html_text


def slow_kept(weights, window, surge):
    """Lines with weight that lie after a surge point without an empty window between, or right before one."""
    n = len(weights)
    held = lambda j: sum(weights[j : j + window])
    points = [s for s in range(n) if weights[s] and held(s) >= surge]
    after = lambda s, x: s <= x and all(held(j) > 0 for j in range(s, x + 1))
    before = lambda s, x: x < s and all(weights[j] for j in range(x, s))
    return [x for x in range(n) if weights[x] and any(after(s, x) or before(s, x) for s in points)]


def test_stretches_equal_the_definition():
    rng, some = random.Random(4), 0
    for _ in range(3000):
        weights = [rng.choice([0, 0, 0, 5, 20, 40, 90, 200]) for _ in range(rng.randint(0, 40))]
        window, surge = rng.randint(1, 4), rng.choice([1, 30, 86, 150])
        stretches = html_text.surge_and_dive(weights, window, surge)
        assert all(b > a and weights[a] and weights[b - 1] for a, b in stretches) and all(x[1] <= y[0] for x, y in zip(stretches, stretches[1:], strict=False))
        got = [x for a, b in stretches for x in range(a, b) if weights[x]]
        assert got == slow_kept(weights, window, surge)
        some += bool(got) and len(got) < sum(map(bool, weights))
    assert some > 300


def test_a_mark_adds_no_weight():
    """A short marked article against long text without a mark; a marked article of short lines; and no mark at all."""
    long = "<div><p>" + "</p><p>".join(["A paragraph that is long enough to surge by itself, with more than eighty-six characters in it."] * 4) + "</p></div>"
    assert html_text.main_text(f"<article><h1>T</h1><p>Short.</p></article>{long}").startswith("A paragraph")
    assert html_text.main_text("<article><h1>Tea</h1><p>Short.</p></article><div><p>Own words.</p></div>") == "Tea\nShort."
    lines = [f"Line {i}." for i in range(12)]
    assert html_text.main_text("<main>" + "".join(f"<p>{x}</p>" for x in lines) + "</main><div><p>By us.</p></div>") == "\n".join(lines)
    body = "Some text of the article, which is long enough for a window of three lines to surge over it all."
    assert html_text.main_text(f"<div><h1>Title</h1><p>{body}</p></div><div>&copy; us, of this place.</div>") == f"Title\n{body}"
