"""Line dedup against a version that compares every run and line with all that came before."""

from __future__ import annotations

import random
import re

import pytest

from readloom.llm import repeats

RUN, MIN_LINE = 9, 3


def brute(docs):
    """{doc_id: (text, runs)} of distinct rows: marks words of runs and lines that occur before, then cuts them out."""
    rows = sorted({(i, t) for i, t in docs if t is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    heads = {}
    for i, t in rows:
        heads.setdefault(t, i)
    runs_seen, lines_seen, out = {}, set(), {}
    for i, t in rows:
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", t)]
        words = [t[a:b] for a, b in spans]
        gone = [False] * len(words)
        lines, at = [], 0
        for line in t.split("\n"):
            n = len(re.findall(r"[^\x20\x09-\x0d]+", line))
            lines.append((at, at + n))
            at += n
        if heads[t] != i:
            for a, b in [(0, len(words))] if len(words) >= RUN else [x for x in lines if x[1] - x[0] >= MIN_LINE]:
                gone[a:b] = [True] * (b - a)
        else:
            for a in range(len(words) - RUN + 1):
                doc, place = runs_seen.setdefault(tuple(words[a : a + RUN]), (i, a))
                if doc != i or a >= place + RUN:
                    gone[a : a + RUN] = [True] * RUN
            for a, b in lines:
                if b - a >= MIN_LINE:
                    if tuple(words[a:b]) in lines_seen:
                        gone[a:b] = [True] * (b - a)
                    lines_seen.add(tuple(words[a:b]))
        runs, k = [], 0
        while k < len(gone):
            if gone[k]:
                end = next((j for j in range(k, len(gone)) if not gone[j]), len(gone))
                runs.append((k, end - 1))
                k = end
            else:
                k += 1
        text, at = "", 0
        for a, b in runs:
            text += t[at : spans[a][0]]
            at = spans[b + 1][0] if b + 1 < len(spans) else spans[-1][1]
        out[i, t] = (text + t[at:], runs)
    return out


def corpus(rng):
    word = lambda: rng.choice("abcdefgh")
    passages = [[f"p{k}{i}" for i in range(rng.randint(5, 40))] for k in range(4)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            p = rng.choice(passages)
            lines.append(" ".join([word() + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 8))]) if kind < 0.4 else " ".join(p) if kind < 0.6 else " ".join([word(), *p[rng.randint(0, 4) :], word()]) if kind < 0.8 else rng.choice(["one two", "the same line", "see also  the\tline", ""]))
        docs.append((i, "\n".join(lines)))
    docs += [(100 + i, t) for i, t in docs[:10]] + [(rng.choice([None, 7, 200]), t) for _, t in docs[5:9]] + [(300, None)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("large", [False, True])
def test_line_dedup_equals_brute_force(spark, monkeypatch, seed, large):
    if large:  # as if tables were too large to send
        monkeypatch.setattr(repeats, "BROADCAST_DOCS", -1)
    docs = corpus(random.Random(seed))
    df = spark.createDataFrame([(i, t, 5, "x", "y", True) for i, t in docs], "doc_id long, text string, k_id int, K_HASH string, k_runs string, k_copy boolean")
    got = {}
    result = repeats.remove_repeats(df, line=5, window=RUN - 4, min_line=MIN_LINE)
    assert result.columns == [*df.columns, "runs"]
    taken = result.collect()
    assert len(taken) == len(docs) and all((r.k_id, r.K_HASH, r.k_runs, r.k_copy) == (5, "x", "y", True) for r in taken)
    want = brute(docs)
    # Nulls count as the last doc_id, so their texts meet as one document's rows.
    kept = sorted(((r.doc_id, r.text, [tuple(x) for x in r.runs]) for r in taken if r.text is not None and r.doc_id is not None))
    assert kept == sorted((i, *want[i, t]) for i, t in docs if t is not None and i is not None)
    assert any(w[1] for w in want.values())
