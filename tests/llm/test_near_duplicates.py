"""Near duplicates against all pairs, with groups that share much but are no near copies."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from readloom.llm import neardup


def brute(rows, size, percent):
    """{(doc_id, text): (n_shingles, component_id)}: unions of all linked pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)), key=lambda k: rows[k][0])
                up[y] = x
    return [(r[0], len(s), None if r[0] is None else rows[top(k)][0]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows = []
    for _ in range(6):  # families: a base, near copies of it, chains of edits, and texts that share about half of it
        base = [word() for _ in range(rng.randint(30, 120))]
        now = list(base)
        for _ in range(8):
            now = list(now)
            now[rng.randrange(len(now))] = word()
            rows.append(" ".join(now))
        for _ in range(12):
            t = list(base)
            for k in range(0, len(t), rng.choice([9, 14, 30])):
                t[k] = word()
            rows.append(" ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
        for _ in range(8):
            rows.append(" ".join(base[: len(base) * 2 // 3] + [word() for _ in range(len(base) // 3)]))
    rows += ["", None, "  \n\t ", "a", "a b", "A  B", "a b c", rows[0], rows[0], rows[30] + " tail"]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True)) + [(None, rows[0]), (ids[3], rows[3])]


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, small):
    if small:  # many tiles, and tables as if too large to send
        monkeypatch.setattr(neardup, "SIGNATURE_TILE", 3)
        monkeypatch.setattr(neardup, "TILE", 2)
        monkeypatch.setattr(neardup, "BROADCAST_IDS", -1)
    rows = corpus(3)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, unit string, rep int")
    got = sorted(map(tuple, neardup.near_duplicates(df, shingle=4, percent=80).collect()), key=str)
    want = sorted(((i, n, c, None if i is None else i == c) for i, n, c in brute(rows, 4, 80)), key=str)
    assert got == want
    assert sum(r[3] is False for r in got) > 40


def test_near_sets_share_a_shingle_of_their_prefixes():
    rng = np.random.default_rng(5)
    frequent = np.sort(rng.integers(0, 400, 60).astype(np.uint64))
    frequent, times = np.unique(frequent, return_counts=True)
    met = 0
    for _ in range(4000):
        base = rng.choice(400, rng.integers(1, 90), replace=False)
        a = np.unique(base[rng.random(len(base)) < rng.choice([0.9, 1.0])]).astype(np.uint64)
        b = np.unique(np.concatenate([base[rng.random(len(base)) < rng.choice([0.85, 0.95, 1.0])], rng.choice(400, rng.integers(0, 6))])).astype(np.uint64)
        percent = int(rng.choice([60, 80, 93]))
        if neardup.linked(a, b, percent):
            small, large = sorted((a, b), key=len)
            head, _ = neardup.prefixes(small, frequent, times, percent)
            assert set(head.tolist()) & set(np.concatenate(neardup.prefixes(large, frequent, times, percent)).tolist())
            met += 1
    assert met > 500


def test_a_shared_template_makes_no_pairs(spark, monkeypatch):
    """Half of every text is the same: all share forms, but few shingles meet, and one near pair among them is found."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    template, rows = words(80), []
    for i in range(400):
        rows.append((i, " ".join(template + words(60))))
    own = rows[7][1].split()
    rows.append((1000, " ".join(own[:-3] + words(3))))
    made = {}
    was = neardup.materialize

    def counted(df, tag):
        out = was(df, tag)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, percent=80).collect()}
    assert got == {i: 7 if i == 1000 else i for i, _ in rows}
    assert made["apart-classes"] > 300 and made.get("token-classes", 0) < 20


def test_a_hub_with_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HUB_PAIRS", 4)
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        t = list(base)
        t[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(t)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, percent=80).collect()
    assert len(got) == 60 and {r.component_id for r in got} == {0}
