"""The language model against plain dictionaries, and both ways of joining against each other."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from readloom.llm import quality
from readloom.llm.quality import ORDER, VOCABULARY

SCHEMA = "doc_id long, text string, lang string, b_lang int, k1 string, cost_sum int, Fold string"


def corpus(seed=5):
    rng = random.Random(seed)
    parts = [a + b for a in "bdfgklmn" for b in "aeiouü"]
    lexicon = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randint(5, 30))), rng.choice(["en", "de", None])) for i in range(60)]
    docs += [(100 + i, "".join(rng.choice("xyz#€😀") for _ in range(60)), "en") for i in range(5)]
    docs += [(200, None, "en"), (201, "", "de"), (3, docs[3][1], "en"), (None, docs[4][1], "fr"), (202, "short", "en")]
    return [(*d, 1, "k", 2, "f") for d in docs]


def symbol(c):
    return ord(c) if ord(c) < VOCABULARY // 2 else VOCABULARY // 2 + ord(c) % (VOCABULARY // 2)


def slow_model(texts):
    """A function of (context, symbol) with the probability, from counts of every order."""
    counts = Counter()
    for t in texts:
        s = (0,) * (ORDER - 1) + tuple(map(symbol, t))
        counts.update(s[i : i + ORDER] for i in range(len(s) - ORDER + 1))
    tables = {ORDER: counts}
    for m in range(ORDER - 1, 0, -1):
        tables[m] = Counter(g[1:] for g in tables[m + 1])
    cuts, contexts = {}, {}
    for m, t in tables.items():
        n = Counter(t.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        cuts[m] = [0.0] + [min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)]
        contexts[m] = defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            contexts[m][g[:-1]][0] += c
            contexts[m][g[:-1]][1] += cuts[m][min(c, 3)]

    def p(gram):
        out = 1 / VOCABULARY
        for m in range(1, ORDER + 1):
            g = gram[-m:]
            if g[:-1] in contexts[m]:
                total, left = contexts[m][g[:-1]]
                c = tables[m].get(g, 0)
                out = (max(c - cuts[m][min(c, 3)], 0) + left * out) / total
        return out

    return p


def perplexity(p, text):
    s = (0,) * (ORDER - 1) + tuple(map(symbol, text))
    return math.exp(-sum(math.log(p(s[i : i + ORDER])) for i in range(len(text))) / len(text))


@pytest.fixture(autouse=True)
def two_folds(monkeypatch):
    monkeypatch.setattr(quality, "FOLDS", 2)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def judged(docs, trusted):
    out = quality.judge(docs, trusted)
    assert out.columns == [*docs.columns, "perplexity", "threshold", "accepted"]
    return sorted(map(tuple, out.collect()), key=str)


def test_perplexities_equal_dictionaries(spark, docs):
    trusted = spark.range(40).withColumnRenamed("id", "doc_id")
    p = slow_model([r[1] for r in corpus() if r[0] is not None and r[0] < 40])
    got = judged(docs, trusted)
    assert len(got) == len(corpus())
    for r in got:
        assert r[3:7] == (1, "k", 2, "f")
        assert r[7] is None if not r[1] else r[7] == pytest.approx(perplexity(p, r[1]), rel=1e-5)


def test_both_ways_of_joining_agree(spark, docs, monkeypatch):
    trusted = spark.range(40).withColumnRenamed("id", "doc_id")
    sent = judged(docs, trusted)
    monkeypatch.setattr(quality, "BROADCAST_GRAMS", -1)
    monkeypatch.setattr(quality, "BROADCAST_IDS", -1)
    assert judged(docs, trusted) == sent
    assert any(not r[9] for r in sent) and any(r[9] for r in sent)
