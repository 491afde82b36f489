"""Language models against probabilities by the textbook recursion, both ways of scoring, and odd rows."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from unicodedata import normalize

import pytest
from pyspark.sql import functions as F

from readloom.llm import langid

SYLLABLES = {"en": ["the", "ing", "er", "on", "and", "th"], "de": ["sch", "ich", "ung", "ü", "ein", "der"], "fr": ["eau", "tion", "é", "ou", "que", "le"]}


def made(lang: str, rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, made(lang, rng, rng.randint(5, 40)), lang) for i in range(450) for lang in [rng.choice(list(SYLLABLES))]]
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "", "de"), (902, "12 34", "fr"), (903, "the und", None)], "doc_id long, text string, lang string")


def symbols(text):
    out, last = [], 0
    for ch in normalize("NFC", text.lower()):
        c = ord(ch) if ch.isalpha() else 0
        c = c if c < langid.VOCABULARY // 2 else langid.VOCABULARY // 2 + c % (langid.VOCABULARY // 2)
        if c or last:
            out.append(c)
        last = c
    return out


def slow_model(texts):
    """The probability of a symbol after a context (tuples), by the definition; counts are dicts, orders recurse."""
    n = langid.ORDER
    seen = {n: Counter()}
    for t in texts:
        s = [0] * (n - 1) + symbols(t)
        seen[n].update(tuple(s[i - n + 1 : i + 1]) for i in range(n - 1, len(s)))
    for m in range(n - 1, 0, -1):
        seen[m] = Counter(g[1:] for g in seen[m + 1])
    cut, after = {}, {}
    for m, c in seen.items():
        one, two = (sum(v == k for v in c.values()) for k in (1, 2))
        cut[m] = one / (one + 2 * two) if one and two else 0.5
        after[m] = defaultdict(list)
        for g, v in c.items():
            after[m][g[:-1]].append(v)

    def p(g):
        m = len(g)
        if m == 0:
            return 1 / langid.VOCABULARY
        shorter = p(g[1:])
        there = after[m].get(g[:-1])
        return (max(seen[m][g] - cut[m], 0) + cut[m] * len(there) * shorter) / sum(there) if there else shorter

    return p


def slow_cost(text, p):
    s = [0] * (langid.ORDER - 1) + symbols(text)
    return sum(-math.log(p(tuple(s[i - langid.ORDER + 1 : i + 1]))) for i in range(langid.ORDER - 1, len(s)))


def test_symbols_of_any_text():
    rng = random.Random(6)
    texts = ["".join(rng.choice("aÀé  .\n1zßΩ漢字𐐀😀İé") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "..."]
    code, lengths = langid.grams(texts)
    at = 0
    for t, n in zip(texts, lengths.tolist(), strict=True):
        s = [0] * (langid.ORDER - 1) + symbols(t)
        assert n == len(s) - langid.ORDER + 1
        for i in range(n):
            assert [code[at + i] >> (langid.BITS * k) & (langid.VOCABULARY - 1) for k in range(langid.ORDER - 1, -1, -1)] == s[i : i + langid.ORDER]
        at += n
    assert at == len(code)


def test_costs_equal_the_recursion(spark, docs, monkeypatch):
    known = docs.filter("lang is not null")
    model = langid.train(known)
    assert model.languages == ["de", "en", "fr"]
    rows = known.collect()
    slow = {lang: slow_model([r.text or "" for r in rows if r.lang == lang]) for lang in model.languages}
    rng = random.Random(9)
    texts = [made("en", rng, 6), made("de", rng, 3), "Zzz 漢字 unseen", "é", None, "", "1 2"]
    asked = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    got = {r.doc_id: r for r in langid.costs_of(asked, model, "costs", "n").collect()}
    for i, t in enumerate(texts):
        assert got[i].n == len(symbols(t or ""))
        for lang, c in zip(model.languages, got[i].costs, strict=True):
            assert abs(c / langid.UNITS - slow_cost(t or "", slow[lang])) < 1e-3 * max(1, got[i].n)
    monkeypatch.setattr(langid, "SENT_CELLS", 0)
    assert {r.doc_id: r for r in langid.costs_of(asked, model, "costs", "n").collect()} == got


def test_predictions(spark, docs):
    model = langid.train(docs)
    rng = random.Random(12)
    rows = [(i, made(lang, rng, 12), lang, "x", 1.0) for i in range(200) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(300, None, "en", "x", 1.0), (301, "", "en", "x", 1.0), (302, "123 !?", "en", "x", 1.0), (None, "the and the", "en", "x", 1.0), (303, "der " * 40_000, "de", "x", 1.0), rows[0]]
    asked = spark.createDataFrame(rows, "doc_id long, text string, source string, costs string, score double")
    got = langid.predict(asked, model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "source", "costs", "score", "lang_pred", "cross_entropy", "accepted"}
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.lang_pred == lang and 0.9 < r.score <= 1 for i, _, lang, *_ in rows[:200] for r in by[i]) and len(by[0]) == 2
    assert [(r.lang_pred, r.score, r.accepted, r.cross_entropy) for i in (300, 301, 302) for r in by[i]] == [("und", 0.0, False, None)] * 3
    assert by[None][0].lang_pred == "en" and by[303][0].lang_pred == "de"
    assert langid.predict(asked.limit(0), model).count() == 0


def test_rejection_and_what_is_no_input(spark, monkeypatch):
    rng = random.Random(21)
    docs = spark.createDataFrame([(i, made(lang, rng, 30), lang) for i in range(3000) for lang in ["en", "de"][i % 2 : i % 2 + 1]], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "TAIL", 0.98)
    model = langid.train(docs)
    assert set(model.limits) == {"en", "de"}
    strange = spark.createDataFrame([(1, "qxzv kjqw xvzq " * 5), (2, made("en", rng, 30))], "doc_id long, text string")
    assert {r.doc_id: r.accepted for r in langid.predict(strange, model).collect()} == {1: False, 2: True}
    held = langid.predict(docs.select("doc_id", "text"), model)
    assert held.filter("not accepted").count() < 0.06 * 3000
    again = langid.predict(docs.select((-F.col("doc_id")).alias("doc_id"), "text", F.lit("zz").alias("lang")), model)
    key = lambda d, sign: sorted((sign * r.doc_id, r.lang_pred, r.score) for r in d.collect())
    assert key(held, 1) == key(again, -1)


def test_nothing_to_learn_from(spark, docs):
    for nothing in (docs.limit(0), docs.filter("lang is null")):
        assert {(r.lang_pred, r.score) for r in langid.predict(docs, langid.train(nothing)).collect()} == {("und", 0.0)}
    empty = langid.train(docs.filter("text is null or text = ''"))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark, tmp_path):
    import zlib

    rng = random.Random(1)
    rows = []
    for i in range(240):
        held = zlib.crc32(str(i).encode()) % 3 == 1
        lang = rng.choice(["en", "de"])
        rows.append((i, made(lang, rng, 20), {"en": "de", "de": "en"}[lang] if held else lang, "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op12_langid(spark, str(tmp_path)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].lang_pred == (lang if not got[i].held_out else {"en": "de", "de": "en"}[lang]) for i, _, lang, *_ in rows)
