"""The stages of the corpus pipeline, one by one and together, on tables with every odd row."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as P
from readloom.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_place int, k_id string, B_lang int"


@pytest.fixture(autouse=True)
def two_folds(monkeypatch):
    monkeypatch.setattr(quality, "FOLDS", 2)


def tables():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ba", "do", "fi", "ku", "le", "mo"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    clean = [(i, text(rng.randint(30, 90))) for i in range(40)]
    near = [(100 + i, t + " " + word()) for i, t in clean[:5]]
    shared = [(200 + i, text(40) + " " + passage + " " + text(40)) for i in range(3)]
    bad = [(300 + i, "".join(rng.choice("#%$xqj") for _ in range(300))) for i in range(3)]
    odd = [(400, None), (401, ""), (402, "  \n"), (403, clean[6][1]), (404, "word " * 4000)]
    return clean, near, shared, bad, odd


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(300, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rows = [(i, t, "en", "s", None, 1, "k", 2) for part in tables() for i, t in part]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/none/labels.parquet")
    return path


def ids(df):
    assert tuple(df.columns) == P.COLUMNS
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_quality_stage(spark, sf_dir):
    kept = ids(P.quality_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir))
    clean, _, _, bad, odd = tables()
    assert not {i for i, _ in bad} & set(kept) and {400, 401, 402} <= set(kept) and len({i for i, _ in clean} & set(kept)) >= 39


def test_line_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = P.line_stage(spark, docs, sf_dir)
    kept = {r.doc_id: r for r in out.collect()}
    clean, _, shared, _, _ = tables()
    passage = shared[0][1].split()[40:100]
    assert all(kept[i].text == t and kept[i].n_chars == len(t) for i, t in clean)
    assert kept[200].text == shared[0][1] and all(" ".join(passage) not in kept[i].text and len(kept[i].text.split()) == 80 for i, _ in shared[1:])
    assert 403 not in kept and kept[400].text is None and kept[401].text == "" and tuple(out.columns) == P.COLUMNS


def test_near_duplicate_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = ids(P.near_duplicate_stage(spark, docs, sf_dir))
    assert not {100, 101, 102, 103, 104, 403} & set(kept) and {*range(40), 400, 401, 402} <= set(kept)


def test_near_duplicates_of_repeated_ids(spark, sf_dir):
    """One row of each group stays, whatever the ids."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a), (1, b), (2, a), (1, a), (None, b), (None, "c " * 9), (None, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, "k", 2) for i, t in rows], DOCS).coalesce(1)
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicate_stage(spark, docs, sf_dir).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, "c " * 9), (None, None), (3, None)], key=str)


def test_packing_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = P.packing_stage(spark, docs, sf_dir).toPandas()
    assert set(out.doc_id) == {r.doc_id for r in docs.collect()} and out.groupby("sequence_id").length.sum().max() <= 2048


def test_whole_pipeline(spark, sf_dir):
    pieces = P.run(spark, sf_dir).toPandas()
    tokens = pieces.groupby("doc_id").length.sum().to_dict()
    clean, near, _, bad, _ = tables()
    assert not tokens.keys() & {403, *(i for i, _ in bad)} and len(tokens.keys() & {i for i, _ in clean}) >= 39 and {400, 401, 402} <= tokens.keys()
    # Of near copies longer than a run, line dedup leaves at most the words around their edits.
    assert all(tokens[i] < tokens[i - 100] / 2 for i, t in near if i in tokens and len(t.split()) > 52)
    assert P.run(spark, f"{sf_dir}/none").count() == 0
