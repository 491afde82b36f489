"""Edge cases and brute-force versions of the training-data operators."""

from __future__ import annotations

import json
import random

import pytest

from readloom.llm import html_text, neardup, packing, pieces, quality, repeats, sharding, syncmers, tool_calls, topk
from readloom.llm.common import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, runs string, unit long"
DOCS = [(1, "a b c d e", "en", "r", 1), (2, None, "en", "r", 1), (3, "", "de", None, 2), (4, "a b c d e", None, "r", 3), (4, "a b c d e", None, "r", 3), (None, "x y", "en", "r", 1), (7, "long " * 3000, "en", "r", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, none):
    path = tokenizer_file("byte_bpe_50k.json")
    assert packing.pack_documents(none, path).count() == 0
    p = packing.pack_documents(docs, path).toPandas()
    assert sorted(p.groupby("doc_id", dropna=False).size().to_dict().items(), key=str) and p.groupby("sequence_id").length.sum().max() <= 2048
    assert p[p.doc_id == 2].length.tolist() == [1] and p[p.doc_id == 7].length.sum() == p[p.doc_id == 7].doc_tokens.iloc[0]


def test_pieces(docs, none):
    path = tokenizer_file("piece_bpe_32k.model")
    assert pieces.encode_decode(none, path).count() == 0
    got = pieces.encode_decode(docs, path).toPandas()
    assert len(got) == len(DOCS) and got[got.doc_id == 2].ids.tolist() == ["2"] and got[got.doc_id == 7].decoded.tolist() == ["long " * 3000]
    coder, rng = pieces.PieceCoder(path), random.Random(5)
    texts = ["".join(rng.choice("abthe \n▁é😀①.") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    for t, (n, ids, decoded) in zip(texts, coder.batch(texts), strict=True):
        want = [*coder.vocabulary.library.encode(t), 2]
        assert list(map(int, ids.split())) == want and n == len(want) and decoded == coder.vocabulary.library.decode(want)


def test_sharding(docs, none):
    assert sharding.shard_documents(none).count() == 0
    got = sharding.shard_documents(docs, shards=3).toPandas()
    assert len(got) == len(DOCS) and all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)


def test_sharding_keeps_copies_together(spark):
    texts = [f"text {i} " * 20 for i in range(40)]
    rows = [(i, texts[i % 40]) for i in range(400)] + [(1000 + i, f"single {i}") for i in range(300)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, units_per_shard=16).toPandas()
    assert (got[got.doc_id < 400].groupby("text_crc32").shard.nunique() == 1).all() and (got.groupby("shard")["size"].sum() < 1.1 * got["size"].sum() / 4).all()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    hot = sharding.shard_documents(spark.createDataFrame([(i, "one text") for i in range(900)] + rows[400:], "doc_id long, text string"), shards=4).toPandas()
    assert hot[hot.doc_id < 900].shard.nunique() > 1 and len(hot) == 1200


def test_topk(spark):
    rows = [(i, [float(i % 7), float(-i % 5), 1.0]) for i in range(60)] + [(200, None), (300, [1.0, None, 2.0]), (400, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (500, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_topk(df, lambda i: i % 20 == 0, k=4, block=8).collect())
    good = [(i, [int(1024 * x) for x in v] + [0] * (3 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)]
    want = []
    for i, q in good:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i)[:4]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.exact_topk(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_line_dedup(docs, none, spark):
    assert repeats.remove_repeats(none).count() == 0
    got = {(r.doc_id, r.lang): r for r in repeats.remove_repeats(docs).collect()}
    assert got[2, "en"].text is None and got[1, "en"].text == "a b c d e" and got[1, "en"].runs == [] and got[None, "en"].text == "x y"
    assert got[4, None].text == "" and [tuple(r) for r in got[4, None].runs] == [(0, 4)]  # a whole line that is there before
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(words[:80])), (2, "x y " + " ".join(words[10:75]) + " z"), (3, " ".join(words[100:149]))], "doc_id long, text string")
    assert {r.doc_id: r.text for r in repeats.remove_repeats(df).collect()} == {1: " ".join(words[:80]), 2: "x y z", 3: " ".join(words[100:149])}


def test_near_duplicates(docs, none):
    assert neardup.near_duplicates(none).count() == 0
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 4).collect()), key=str)
    assert (1, 2, 1, True) in got and got.count((4, 2, 1, False)) == 2 and (2, 0, 2, True) in got and (None, 1, None, None) in got


def test_fingerprints(docs, none):
    assert syncmers.fingerprints(none).count() == 0
    got = syncmers.fingerprints(docs).toPandas()
    assert len(got) == len(DOCS) and got[got.doc_id.isin([1, 4])].fingerprint.nunique() == 1 and got.near_edited.between(0, 1).all()


def test_fingerprints_are_whole_and_ordered(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base = [word() for _ in range(900)]
    passage = base[300:400]
    texts = [base, base[450:] + base[:450], [word() for _ in range(400)] + passage + [word() for _ in range(400)] + passage, base[:200] * 3, base[:200] * 2 + base[500:600] + base[:200]]
    rows = [(len(texts) - i, " ".join(t)) for i, t in enumerate(texts)]
    got = sorted(fp for fp in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())[::-1]
    prints = [r.fingerprint.split() for r in got]
    assert all(len(f) > 0.5 * len(t) for f, t in zip(prints, texts, strict=True))
    assert all((p := list(map(int, r.places.split()))) == sorted(set(p)) and len(p) == len(f) for r, f in zip(got, prints, strict=True))

    def brute(a, b):  # the longest common subsequence
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *(old := row)[1:]]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return row[-1] / (len(a) + len(b) - row[-1])

    for i, r in enumerate(got):
        assert r.near_edited == pytest.approx(brute(prints[i], r.edited_fingerprint.split()), abs=0.12)
    assert got[0].near_next == pytest.approx(brute(prints[0], prints[1])) and 0.25 < got[0].near_next < 0.4
    assert got[3].near_next == pytest.approx(brute(prints[3], prints[4]), abs=0.02)


def test_html():
    page = "<body><nav>x</nav><article><h1>T</h1><p>A &amp; b&nbsp;c<p><b>d</b>e</article><footer>f</footer>"
    assert html_text.main_text(page) == "T\nA & b c\nde" and html_text.main_text("") == ""
    assert html_text.main_text('<p>Hello there.</p><div class="comments"><p>no</p></div>') == "Hello there."


def test_quality(docs, none, spark, monkeypatch):
    monkeypatch.setattr(quality, "FOLDS", 2)
    trusted = spark.createDataFrame([(1,), (7,)], "doc_id long")
    assert quality.judge(none, trusted).count() == 0
    assert quality.judge(docs, trusted).filter("accepted").count() >= len(DOCS) - 1
    assert quality.judge(docs, trusted.limit(0)).filter("accepted").count() == len(DOCS)


def test_quality_keeps_clean_documents(spark):
    rng = random.Random(3)
    parts = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    lexicon = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    rows = [(i, " ".join(rng.choice(lexicon) for _ in range(rng.randint(20, 60))), "en") for i in range(260)]
    rows += [(1000 + i, "".join(rng.choice("qxjwyhc#%$") for _ in range(200)), "en") for i in range(20)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.range(160).withColumnRenamed("id", "doc_id"))
    gone = [r.doc_id for r in judged.filter("not accepted").collect()]
    assert sum(160 <= i < 260 for i in gone) <= 5 and sum(i >= 1000 for i in gone) == 20


def test_kneser_ney_sums_to_one(spark):
    import pyarrow as pa

    code, _ = quality.grams(["the cat sat on the mat, the cat ate"])
    seen = spark.createDataFrame(pa.table({"gram": code}).to_pandas()).groupBy("gram").count().withColumnRenamed("count", "c")
    context = int(code[3]) >> quality.BITS << quality.BITS
    every = spark.createDataFrame([(context | w,) for w in range(quality.VOCABULARY)], "gram long").join(seen, "gram", "left").fillna(0)
    others = seen.join(every.select("gram"), "gram", "left_anti")
    targets = every.unionByName(others).selectExpr(f"{quality.FOLDS} as model", "gram", "c")
    found = quality.probabilities(targets, targets.filter("c > 0")).selectExpr(f"gram & {quality._mask(quality.ORDER)} as gram", "cost")
    p = found.filter(f"gram >> {quality.BITS} = {context >> quality.BITS}").toPandas()
    assert len(p) == quality.VOCABULARY and (2.718281828459045 ** (-p.cost / quality.UNITS)).sum() == pytest.approx(1, abs=1e-5)


def test_tool_calls(spark):
    calls = spark.createDataFrame([(1, 0, "a", "f", '{"x":1}', None), (1, 2, "b", "f", '{"x":"s","y":2}', "a"), (1, 4, "c", "g", "{bad", "b"), (1, 5, "a", "f", "{}", None), (1, 6, "p", "f", '{"x":1}', "q"), (1, 7, "q", "f", '{"x":1}', "p"), (1, 8, None, "f", None, None)], "conv_id long, turn long, call_id string, tool string, arguments string, parent_id string")
    results = spark.createDataFrame([("a", 1, "ok"), ("z", 3, "?")], "call_id string, turn long, content string")
    schemas = spark.createDataFrame([("f", [("x", "integer", True)])], tool_calls.TURN_SCHEMA)
    got = {(r.call_id, tuple(r.errors)): (r.depth, r.message) for r in tool_calls.link_tool_calls(calls, results, schemas).collect()}
    assert got["a", ()] == (0, '{"arguments":{"x":1},"call_id":"a","depth":0,"result":"ok","tool":"f"}')
    assert got["b", ("no_result", "type:x", "unknown:y")][0] == 1 and got["c", ("invalid_arguments", "no_result", "unknown_tool")][0] == 2
    assert {("a", ("duplicate_call",)), ("z", ("orphan_result",)), (None, ("missing_id",))} <= got.keys()
    assert any(k[0] == "p" and "cycle" in k[1] for k in got)


def test_tool_calls_keep_every_row(spark):
    calls = spark.createDataFrame([(1, 0, "a", "f", '{"x":1}', None), (2, 0, "a", "g", '{"x":2}', "b"), (3, 4, "a", "f", '{"x":3}', None), (3, 4, "a", "f", '{"x":3}', None), (4, None, None, "f", "{}", None)], "conv_id long, turn long, call_id string, tool string, arguments string, parent_id string")
    results = spark.createDataFrame([("a", 5, "late"), ("a", 1, "first"), ("a", 5, "late"), (None, 9, "lost"), ("z", 3, "?"), ("z", 4, "??")], "call_id string, turn long, content string")
    schemas = spark.createDataFrame([("f", [("x", "integer", True)]), ("g", [("x", "integer", True)])], tool_calls.TURN_SCHEMA)
    got = [json.loads(r.message) | {"turn": r.turn, "conv": r.conv_id, "errors": ",".join(r.errors)} for r in tool_calls.link_tool_calls(calls, results, schemas).collect()]
    assert sorted((r["conv"], r["arguments"]["x"]) for r in got if r["call_id"] == "a" and r["tool"]) == [(1, 1), (2, 2), (3, 3), (3, 3)]
    assert sum(r["errors"] == "duplicate_call" for r in got) == 3 and sum(r["result"] == "first" for r in got) == 1
    assert sorted((r["turn"], r["result"]) for r in got if r["errors"] == "duplicate_result") == [(4, "??"), (5, "late"), (5, "late")]
    assert sorted((r["conv"] or 0, r["result"]) for r in got if r["errors"] == "missing_id") == [(0, "lost"), (4, None)] and len(got) == 10


def test_next_documents_in_many_buckets(spark):
    """Whatever the buckets, texts follow each other by doc_id, and equal doc_ids by their texts' hash."""
    rng = random.Random(4)
    rows = [(i * i * 7919, f"text {i} " * rng.randint(1, 9)) for i in range(300)] + [(None, f"null {i} abc def") for i in range(200)] + [(5, f"five {i} abc def ghi") for i in range(150)] + [(1 << 62, "far"), (-(1 << 62), "low")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    hashed = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    line = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashed[r[1]]), reverse=True)
    want = sorted(((i, t, line[(k + 1) % len(line)][1]) for k, (i, t) in enumerate(line)), key=str)
    for buckets in (1, 3, 40, 3000):
        got = syncmers.with_next(df, syncmers.F.coalesce("doc_id", syncmers.F.lit(syncmers._LOWEST)), buckets, lambda r: r.withColumn("fp", syncmers.F.lit(0)))
        assert sorted(((r.doc_id, r.text, r.next_text) for r in got.collect()), key=str) == want
    spread = syncmers.bucketed(df.selectExpr("coalesce(doc_id, -9223372036854775808) as place", "xxhash64(text) as tie"), 40)
    assert max(r["count"] for r in spread.groupBy("bucket", "part").count().collect()) < 60
    assert syncmers.bucketed(df.limit(0).selectExpr("doc_id as place", "xxhash64(text) as tie"), 4).count() == 0


def test_fingerprints_equal_brute_force(spark):
    """Chosen windows, edited texts and empty texts against plain loops over words."""
    import hashlib

    import xxhash

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "δ", "\te", "f\n"]) for _ in range(rng.randint(0, 30))) for _ in range(12)] + [None, "", "one two"]
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seeded = lambda b, seed: int.from_bytes(xxhash.xxh64(b, seed=seed & (1 << 64) - 1).digest(), "big")
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(values):
        h = 42
        for v in values:
            h = seeded((v & (1 << 64) - 1).to_bytes(8, "little"), h)
        return h

    def brute(t):
        w = [signed(seeded(x.encode(), 42)) for x in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        inner = [signed(chain(w[i : i + syncmers.S])) for i in range(len(w) - syncmers.S + 1)]
        out = []
        for i in range(len(w) - syncmers.K + 1):
            own = inner[i : i + syncmers.K - syncmers.S + 1]
            if min(own) in (own[0], own[-1]):
                out.append((i, chain(w[i : i + syncmers.K]) & 0x7FFFFFFF))
        return out if len(w) >= syncmers.K else None if w else []

    line = sorted(got, reverse=True)
    for k, i in enumerate(line):
        own, after = texts[i] or "", texts[line[(k + 1) % len(line)]] or ""
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for text, prints, places in ((own, got[i].fingerprint, got[i].places), (edited, got[i].edited_fingerprint, got[i].edited_places)):
            want = brute(text)
            if want is not None:
                assert list(zip(map(int, places.split()), map(int, prints.split()), strict=True)) == want


def best_by_brute_force(rows, is_query, k):
    whole = lambda v: [int(1024 * x // 1) for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = []
    for i, q in sorted({(i, tuple(q)) for i, q in good if is_query(i)}):
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


def test_topk_over_ranges(spark):
    """Floors carried from range to range; repeated ids, infinite components, and other columns of the operator's names."""
    rng = random.Random(6)
    rows = [(rng.randint(0, 40), [rng.choice([-1.5, 0.25, 3.0, rng.random()]) for _ in range(rng.randint(1, 4))]) for _ in range(300)] + [(7, [float("inf"), 1.0]), (None, [2.0]), (5, None), (10, [])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, score int, vec string, batch int")
    for options in ({"range_rows": 20, "batch_queries": 3, "block": 4}, {}):
        got = sorted(map(tuple, topk.exact_topk(df, lambda i: i % 10 == 0, k=5, **options).collect()))
        assert got == sorted(best_by_brute_force(rows, lambda i: i % 10 == 0, 5))


def test_topk_opens_few_blocks_of_clusters(spark):
    rng = random.Random(8)
    centres = [[rng.choice([-4.0, 4.0]) for _ in range(8)] for _ in range(16)]
    rows = [(i, [x + rng.random() * 0.1 for x in centres[i % 16]]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met = topk.cells(df, lambda i: i % 100 == 0, range_rows=400, block=16)
    shares = met.groupBy("query_key", "range_id").agg({"scored": "max", "blocks": "max"}).toDF("q", "r", "scored", "blocks").toPandas()
    assert shares.scored.sum() < 0.25 * shares.blocks.sum()
    assert sorted(map(tuple, topk.exact_topk(df, lambda i: i % 100 == 0, range_rows=400, block=16).collect())) == sorted(best_by_brute_force(rows, lambda i: i % 100 == 0, 10))


def test_tool_calls_of_empty_tables_and_long_texts(spark):
    calls = spark.createDataFrame([(1, 0, "a", "f", json.dumps({"x": "y" * 200_000}), None, "extra")], "conv_id long, turn long, call_id string, tool string, arguments string, parent_id string, depth string")
    results = spark.createDataFrame([("a", 1, "z" * 200_000, 5)], "call_id string, turn long, content string, n int")
    two = spark.createDataFrame([("f", [("x", "string", True)]), ("f", [("q", "string", True)]), ("f", [("q", "string", True)])], tool_calls.TURN_SCHEMA)
    (r,) = tool_calls.link_tool_calls(calls, results, two).collect()
    assert r.errors == ["missing:q", "unknown:x"] and len(r.message) > 400_000  # the schema with q comes first
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), two.limit(0)).count() == 0
    (lost,) = tool_calls.link_tool_calls(calls.limit(0), results, two).collect()
    assert lost.errors == ["orphan_result"]


def test_packing_keeps_every_id_once(spark):
    """Pieces of each document against its ids, sequences against their capacity, over many windows."""
    path = tokenizer_file("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "\n", "Straße", "😀", "<|endoftext|>", "x" * 30]) for _ in range(rng.choice([0, 3, 40, 400, 3000]))) for i in range(60)}
    df = spark.createDataFrame([(i, t, "d", 5) for i, t in texts.items()] + [(None, "one two", "d", 5)], "doc_id long, text string, ids string, start int").repartition(2)
    p = packing.pack_documents(df, path, capacity=256, window_pieces=16, window_ids=3000).toPandas()
    encode = packing.ByteLevelEncoder(path).exact
    for i, t in texts.items():
        own = p[p.doc_id == i].sort_values("start")
        got = [int.from_bytes(b[k : k + 4], "little") for b in own.ids for k in range(0, len(b), 4)]
        assert got == [*encode.encode(t, add_special_tokens=False).ids, packing.END_ID] and set(own.doc_tokens) == {len(got)}
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    sums = []
    for _, s in p.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        sums.append(int(s.length.sum()))
    assert max(sums) <= 256 and sum(256 - n for n in sums if n & (n - 1)) <= 0.02 * sum(sums)


def test_fill_finds_the_closest_sum():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        capacity = rng.randint(5, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= capacity}
        chosen = packing.fill(counts, capacity)
        assert sum(n * k for n, k in chosen.items()) == max(sums) and all(0 < k <= counts[n] for n, k in chosen.items())


def test_placement_equals_brute_force():
    import numpy as np

    rng = random.Random(4)
    vectors = np.array([[rng.randint(1, 90), rng.randint(1, 20), 1] for _ in range(60)], float)
    weights = [w**0.5 for w in sharding.WEIGHTS]
    need = [[v / t * 4 * w for v, t, w in zip(row, vectors.sum(axis=0), weights, strict=True)] for row in vectors]
    room, want = [list(weights) for _ in range(4)], [0] * 60
    for i in sorted(range(60), key=lambda i: (-sum(need[i]), i)):
        want[i] = max(range(4), key=lambda s: (round(sum(a * b for a, b in zip(room[s], need[i], strict=True)), 12), -s))
        room[want[i]] = [a - b for a, b in zip(room[want[i]], need[i], strict=True)]
    assert sharding.place(vectors, 4).tolist() == want


def test_pages(spark, none):
    article = "<nav><a>x</a></nav><article><h1>T</h1>" + "<p>Some text of the article, long enough.</p>" * 3000 + "<p class='reply'>Own words.</p><div class='comments'><p>No.</p></div></article><footer>f</footer>"
    plain = "<div><ul><li><a>Menu one</a></li><li><a>Menu two</a></li></ul></div><div>Short promo line</div><div>" + "".join(f"<p>Paragraph {i} holds some words of its own, as all of them do here.</p>" for i in range(6)) + "</div><div>&copy; owner</div>"
    parts = "<div>" + "<p>The first part of a text that goes on below the links, and is long.</p>" * 4 + "<p><a>l1</a></p><p><a>l2</a></p><p><a>l3</a></p><p><a>l4</a></p>" + "<p>And the second part, shorter, yet a part of the same text all the same.</p>" * 2 + "</div>"
    rows = [(1, "u", article, "t", 1), (2, None, None, "t", 1), (3, "u", "", "t", 1), (None, "u", plain, "t", 1), (1, "u", article, "t", 1), (5, "u", parts, "t", 1), (6, "u", "<p>only this", "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n int")
    got = html_text.extract_pages(df).collect()
    assert [r.page_id for r in got] == [r[0] for r in rows] and [r.url for r in got] == [r[1] for r in rows]
    text = [r.text for r in got]
    assert text[0] == text[4] == "T\n" + "Some text of the article, long enough.\n" * 3000 + "Own words." and text[1] == text[2] == ""
    assert text[3].split("\n") == [f"Paragraph {i} holds some words of its own, as all of them do here." for i in range(6)]
    assert text[5].count("first part") == 4 and text[5].count("second part") == 2 and text[6] == "only this"
    assert html_text.extract_pages(df.limit(0)).count() == 0
