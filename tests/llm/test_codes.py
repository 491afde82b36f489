"""Product codes against a plain Lloyd that knows no differences, and odd rows."""

from __future__ import annotations

import math
import random

import numpy as np

from readloom.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label string, code string, `row` int, whole int"


def slow(rows, parts, entries, rounds, scale):
    """All sums anew in every round, one part after the other."""
    good = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in good), default=0)
    width = max(-(-longest // parts), 1)
    whole = [[math.floor(scale * x) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in good]
    firsts = sorted((i, w) for (i, _, _), w in zip(good, whole, strict=True) if i is not None)[:entries]
    part = lambda w, p: w[p * width : (p + 1) * width]
    books = [[part(w, p) for _, w in firsts] for p in range(parts)]

    def near(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        at = [[near(part(w, p), books[p])[0] for p in range(parts)] for w in whole]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [part(w, p) for w, a in zip(whole, at, strict=True) if a[p] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for (i, _, lab), w in zip(good, whole, strict=True):
        found = [near(part(w, p), books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{j:02x}" for j, _ in found), sum(d for _, d in found)))
    return out, books


def rows(n, rng, width=12):
    made = [(i * 3 - 40, [rng.choice([-1, 1]) * rng.random() ** 3 + (i % 4) for _ in range(width)], rng.choice(["a", "a", "b", None]), "x", 1, 2) for i in range(n)]
    made += [made[5], made[6], (7, None, "a", "x", 1, 2), (8, [1.0, None] * 6, "a", "x", 1, 2), (9, [float("nan")] * width, "a", "x", 1, 2), (10, [float("inf")] * width, None, "x", 1, 2)]
    return [*made, (None, [0.25] * width, "b", "x", 1, 2), (500, [0.5] * 3, "b", "x", 1, 2), (501, [], "c", None, None, None)]


def as_set(found):
    return sorted(found, key=str)


def test_equal_to_plain_rounds(spark):
    rng = random.Random(3)
    for n, parts, entries, rounds, width in ((90, 4, 5, 4, 12), (40, 4, 16, 6, 10), (3, 2, 16, 2, 8)):
        data = rows(max(n, 7), rng, width)[: n + 30]
        df = spark.createDataFrame(data, SCHEMA).repartition(3)
        got, books = codes.product_codes(df, parts, entries, rounds, 64)
        want, want_books = slow(data, parts, entries, rounds, 64)
        assert books.tolist() == want_books
        assert as_set(map(tuple, got.collect())) == as_set(want)


def test_the_rounds_move_and_only_changes_are_kept(spark):
    """Late rounds hold the components of few parts; the sums are still those of all."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)) + rng.integers(0, 3, size=(400, 1)) * 4
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    kept: list[int] = []
    was = codes.Bucketed.write

    def write(self, frame, tag):
        out = was(self, frame, tag)
        if tag == "assigned":
            kept.append(sum(len(r.moved) for r in out.collect()))
        return out

    codes.Bucketed.write = write
    try:
        _, books = codes.product_codes(df, 2, 4, 6, 64)
    finally:
        codes.Bucketed.write = was
    assert kept[0] == 400 * 8 and kept[-1] < kept[0] / 4
    assert books.tolist() == slow([(i, v.tolist(), "a") for i, v in enumerate(x)], 2, 4, 6, 64)[1]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("codes_")]


def test_empty_and_all_bad(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert codes.product_codes(none)[0].count() == 0
    assert codes.product_codes(spark.createDataFrame([(1, None, "a", "x", 1, 2)], SCHEMA))[0].count() == 0
    nameless, books = codes.product_codes(spark.createDataFrame([(None, [0.5] * 8, None, "x", 1, 2)], SCHEMA))
    assert [(r.code, r.error) for r in nameless.collect()] == [("00" * 8, 0)] and (books == 2048).all()


def test_label_sums_by_both_ways(spark, monkeypatch):
    data = [(i, None if i % 5 == 0 else "hot" if i % 2 else f"l{i}", "00", i) for i in range(300)]
    df = spark.createDataFrame(data, "vec_id long, label string, code string, error long")
    plain = as_set(map(tuple, codes.label_sums(df).select("vec_id", "label_error").collect()))
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 3)
    monkeypatch.setattr(codes, "HOT_SHARE", 20)
    assert as_set(map(tuple, codes.label_sums(df).select("vec_id", "label_error").collect())) == plain
    total = {}
    for _, lab, _, e in data:
        total[lab] = total.get(lab, 0) + e
    assert plain == as_set((i, total[lab]) for i, lab, _, _ in data)


def test_components_are_cut_at_a_bound(spark):
    df = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [list(r.whole) for r in codes.whole_vectors(df).orderBy("vec_id").collect()] == [[codes.LARGEST, -codes.LARGEST], [0, 0]]
