"""Operator 12: the language of a text by interpolated Kneser-Ney models of characters, one for each language.

Symbols are lower-cased letters; whatever lies between letters is one mark, so digits, markup and line ends say nothing.
A symbol has ``BITS`` bits (letters up to 2047 have one each, others share 2048), so an n-gram is a long, and with its
order in the bits above it is a hash key. Each task counts the n-grams of its rows; lower orders, discounts and contexts
are aggregates of the summed counts. A model is a table (key, lang, over, back): what seeing the n-gram adds to its
probability, and the weight of the shorter context after it. Executors get it as arrays sorted by key while it is small
enough for that (``SENT_CELLS``); beyond, the distinct n-grams of the texts meet it in a join. Costs, -ln p, are whole
units, so both ways give the same sums.

A text is of the language with the lowest cost by symbol. An eighth of the texts to learn from is scored by models that do
not have it: it says how far the difference of two languages' costs is to be trusted (the rate by which differences
become shares, chosen by log loss), and which cost by symbol is too high for a language's own texts (``TAIL``, where they are enough to tell); beyond
that a prediction is not accepted. The models that predict have all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize, returned, table
from .wordhash import parts

ORDER, BITS = 4, 12
VOCABULARY = 1 << BITS
UNITS = 1 << 16
UNKNOWN = "und"
#: Texts to learn from of which one part calibrates, and the share of a language's texts below its limit.
CALIBRATION, TAIL = 8, 0.995
#: Texts with fewer letters are accepted whatever they cost.
MIN_LETTERS = 20
#: By what a difference of costs (in nats) is divided before it becomes a share; the one with the least log loss is taken.
RATES = tuple(1 / (1 << k) for k in range(9))
#: Languages at most, and (keys x languages) of a model that is sent to all executors.
MOST_LANGUAGES, SENT_CELLS = 1000, 6_000_000
_FLUSH = 400_000


def _mask(order: int) -> int:
    return (1 << (BITS * order)) - 1


def _key(code, order: int):
    """The hash key of an n-gram of an order (codes as arrays or columns)."""
    return code + (order << (BITS * ORDER))


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """By code point of the basic plane, the symbol of a letter; 0 for what is none."""
    return np.array([(i if i < VOCABULARY // 2 else VOCABULARY // 2 + i % (VOCABULARY // 2)) if chr(i).isalpha() else 0 for i in range(1 << 16)], np.int64)


def _points(text: str) -> np.ndarray:
    text = text.lower()
    if not is_normalized("NFC", text):
        text = normalize("NFC", text)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(one code of the last ORDER symbols a symbol, symbols of every text); a text without letters has no symbols."""
    points = [_points(t) for t in texts]
    flat = np.concatenate([*points, np.empty(0, "<u4")]).astype(np.int64)
    sizes = np.array([len(p) for p in points], np.int64)
    begins = np.cumsum(sizes) - sizes
    symbol = _symbols()[np.minimum(flat, (1 << 16) - 1)]
    for at in np.nonzero(flat >= 1 << 16)[0].tolist():
        symbol[at] = VOCABULARY // 2 + flat[at] % (VOCABULARY // 2) if chr(flat[at]).isalpha() else 0
    before = np.concatenate([[0], symbol[:-1]])[: len(symbol)]
    before[begins[sizes > 0]] = 0
    keep = (symbol != 0) | (before != 0)  # of marks in a row the first one, and none in front
    lengths = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([begins, [len(flat)]])]) if len(texts) else sizes
    pad = ORDER - 1
    padded = np.zeros(int(lengths.sum()) + pad * len(texts), np.int64)
    own = np.arange(int(lengths.sum())) + np.repeat(np.arange(1, len(texts) + 1) * pad, lengths)
    padded[own] = symbol[keep]
    code = padded.copy()
    for i in range(1, ORDER):
        code[i:] |= padded[:-i] << (BITS * i)
    return code[own], lengths


def chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part in parts(batches, text_at):
        yield part, [t.as_py() or "" for t in part.column(text_at)]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, held, gram, c) of ``docs`` (text, lang, held), counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([h[1] for h in held]), len(codes)).astype(np.int64)

        def done(codes: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = list(groups)
            for i in range(0, len(codes), 100_000):
                which = (codes[i : i + 100_000] >> (BITS * ORDER)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([names[w][0] for w in which], pa.string()), pa.array([names[w][1] for w in which], pa.bool_()), pa.array(codes[i : i + 100_000] & _mask(ORDER)), pa.array(count[i : i + 100_000])], names=["lang", "held", "gram", "c"])

        for part, texts in chunks(batches, 0):
            code, lengths = grams(texts)
            which = [groups.setdefault(k, len(groups)) for k in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            held.append(np.unique(code | np.repeat(np.array(which, np.int64), lengths) << (BITS * ORDER), return_counts=True))
            if sum(len(h[0]) for h in held) > _FLUSH:
                held = [merged()]
                if len(held[0][0]) > _FLUSH // 2:
                    yield from done(*held.pop())
        if held:
            yield from done(*merged())

    found = docs.select("text", "lang", "held").mapInArrow(returned(run), "lang string, held boolean, gram long, c long")
    return found.groupBy("lang", "held", "gram").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame) -> DataFrame:
    """(key, lang, over, back) from counts (lang, gram, c) of the highest order.

    Below the highest order an n-gram counts as often as there are symbols before it. The discount of an order is
    n1 / (n1 + 2 n2), or a half where one of both is 0.
    """
    now, found = counts, []
    for m in range(ORDER, 0, -1):
        if m < ORDER:
            now = materialize(now.groupBy("lang", F.col("gram").bitwiseAND(F.lit(_mask(m))).alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"lang-order-{m}")
        once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        cut = now.groupBy("lang").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("cut"))
        rows = now.join(F.broadcast(cut), "lang").withColumn("h", F.shiftright("gram", BITS))  # a row a language
        context = rows.groupBy("lang", "h").agg(F.sum("c").cast("double").alias("total"), (F.first("cut") * F.count(F.lit(1)) / F.sum("c")).alias("back"))
        found.append(context.select(_key(F.col("h"), m - 1).alias("key"), "lang", F.lit(0.0).alias("over"), "back"))
        found.append(rows.join(context.drop("back"), ["lang", "h"]).select(_key(F.col("gram"), m).alias("key"), "lang", ((F.col("c") - F.col("cut")) / F.col("total")).alias("over"), F.lit(None).cast("double").alias("back")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("key", "lang").agg(F.max("over").alias("over"), F.coalesce(F.max("back"), F.lit(1.0)).alias("back"))


class Arrays:
    """A model as arrays sorted by key, with a row a language."""

    def __init__(self, keys: np.ndarray, which: np.ndarray, over: np.ndarray, back: np.ndarray, languages: int):
        self.keys, at = np.unique(keys, return_inverse=True)
        # A last place stands for what no language has.
        self.over, self.back = np.zeros((languages, len(self.keys) + 1)), np.ones((languages, len(self.keys) + 1))
        self.over[which, at], self.back[which, at] = over, back

    def place(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == keys, at, len(self.keys)) if len(self.keys) else np.zeros(len(keys), np.int64)

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """By language and code, what the last symbol costs after those before it."""
        p = np.full((len(self.over), len(codes)), 1.0 / VOCABULARY)
        for m in range(1, ORDER + 1):
            p = self.over[:, self.place(_key(codes & _mask(m), m))] + self.back[:, self.place(_key((codes >> BITS) & _mask(m - 1), m - 1))] * p
        return np.rint(-np.log(p) * UNITS).astype(np.int64)


@dataclass
class Model:
    """Languages in order of their names, the table (key, lang, over, back), and what calibration found."""

    languages: list[str]
    rows: DataFrame
    rate: float = RATES[4]
    limits: dict[str, float] = field(default_factory=dict)

    def sent(self):
        """The arrays on every executor; None if they are too large for that."""
        if self.rows.select("key").distinct().count() * len(self.languages) > SENT_CELLS:
            return None
        t = self.rows.toArrow()
        which = np.searchsorted(np.array(self.languages, object), np.array(t.column("lang").to_pylist(), object)) if len(t) else np.empty(0, np.int64)
        return self.rows.sparkSession.sparkContext.broadcast(Arrays(t.column("key").to_numpy(), which, t.column("over").to_numpy(), t.column("back").to_numpy(), len(self.languages)))


def costs_of(docs: DataFrame, model: Model, costs: str, n: str) -> DataFrame:
    """``docs`` with the cost of the text in every language (an array in their order) and its number of symbols."""
    sent = model.sent()
    return _costs_by_join(docs, model, costs, n) if sent is None else _costs_sent(docs, sent, costs, n)


def _costs_sent(docs: DataFrame, sent, costs: str, n: str) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part, texts in chunks(batches, at):
            code, lengths = grams(texts)
            found, back = np.unique(code, return_inverse=True)
            ends = np.cumsum(lengths)
            sums = np.zeros((len(texts), len(model.over)), np.int64)
            for j, c in enumerate(model.costs(found)):
                total = np.concatenate([[0], np.cumsum(c[back])])
                sums[:, j] = total[ends] - total[ends - lengths]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(lengths)], names=[*part.schema.names, costs, n])

    return docs.mapInArrow(returned(run), docs.withColumns({costs: F.lit(None).cast("array<long>"), n: F.lit(None).cast("long")}).schema)


def _costs_by_join(docs: DataFrame, model: Model, costs: str, n: str) -> DataFrame:
    """The same where the model is too large to send: distinct n-grams of distinct texts meet it by key."""
    languages = model.languages

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found, m = np.unique(grams([text.as_py() or ""])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k1, np.int64)), pa.array(np.full(len(found), k2, np.int64)), pa.array(found), pa.array(m.astype(np.int64))], names=["k1", "k2", "gram", "m"])

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = [x for x in rows if x["key"] is not None and x["lang"] is not None]
                a = Arrays(np.array([x["key"] for x in r], np.int64), np.array([languages.index(x["lang"]) for x in r], np.int64), np.array([x["over"] for x in r], float), np.array([x["back"] for x in r], float), len(languages))
                yield pa.RecordBatch.from_arrays([pa.array([gram], pa.int64()), pa.array([a.costs(np.array([gram], np.int64))[:, 0].tolist()], pa.list_(pa.int64()))], names=["gram", "costs"])

    keys = {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), F.reverse("text"))}
    texts = docs.select("text").withColumns(keys).groupBy("k1", "k2").agg(F.first("text").alias("text")).select("k1", "k2", "text")
    held = materialize(texts.mapInArrow(returned(counted), "k1 long, k2 long, gram long, m long"), "text-grams")
    g = F.col("gram")
    wanted = [k for m in range(1, ORDER + 1) for k in (_key(g.bitwiseAND(F.lit(_mask(m))), m), _key(F.shiftright(g, BITS).bitwiseAND(F.lit(_mask(m - 1))), m - 1))]
    asked = held.select("gram").distinct().select("gram", F.explode(F.array_distinct(F.array(*wanted))).alias("key"))
    met = asked.join(model.rows, "key", "left").groupBy("gram").agg(F.collect_list(F.struct("key", "lang", "over", "back")).alias("rows"))  # bounded: orders x languages
    price = met.mapInArrow(returned(priced), "gram long, costs array<long>")
    each = held.join(price, "gram").select("k1", "k2", "m", F.posexplode("costs").alias("j", "cost"))
    sums = each.groupBy("k1", "k2", "j").agg(F.sum(F.col("m") * F.col("cost")).alias("cost"), F.sum("m").alias("n"))
    sums = sums.groupBy("k1", "k2").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "cost"))), lambda x: x["cost"]).alias(costs), F.max("n").alias(n))
    k1, k2 = free_names([*docs.columns, costs, n], "k1", "k2")
    none = F.array_repeat(F.lit(0).cast("long"), len(languages))
    joined = docs.withColumns({k1: keys["k1"], k2: keys["k2"]}).join(sums.withColumnsRenamed({"k1": k1, "k2": k2}), [k1, k2], "left")
    return joined.withColumns({costs: F.coalesce(costs, none), n: F.coalesce(n, F.lit(0))}).select(*docs.columns, costs, n)


def _share(costs: Column, of: Column, rate: float) -> Column:
    """The share of the language with cost ``of`` when differences of costs count by ``rate``."""
    return F.lit(1.0) / F.aggregate(costs, F.lit(0.0), lambda s, c: s + F.exp(F.greatest(F.least((of - c) * F.lit(rate / UNITS), F.lit(700.0)), F.lit(-700.0))))


def train(docs: DataFrame) -> Model:
    """The model of ``docs`` (text, lang), with its calibration; rows without a language teach nothing.

    Null and empty texts and texts without letters have no n-grams; repeated rows count as often as they are there.
    """
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null")
    known = known.withColumn("held", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(CALIBRATION)) == 0)
    counts = materialize(count_grams(known), "lang-grams")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    model = Model(languages, materialize(fit(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c"))), "lang-model"))
    if not languages:
        return model
    part = Model(languages, materialize(fit(counts.filter("not held").drop("held")), "lang-part"))
    own = costs_of(known.filter("held").select("text", "lang"), part, "costs", "n").filter("n > 0")
    true = F.get("costs", F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") - 1)
    loss = [F.sum(F.round(-F.log(F.greatest(_share(F.col("costs"), true, r), F.lit(1e-300))) * UNITS).cast("long")) for r in RATES]
    own = materialize(own.select("lang", "costs", "n", true.alias("true")), "calibration")
    losses = [x for x in own.agg(*loss).first()]
    if losses[0] is not None:
        model.rate = RATES[min(range(len(RATES)), key=lambda i: losses[i])]
    bars = own.filter(F.col("n") >= MIN_LETTERS).groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.percentile_approx(F.col("true") / UNITS / F.col("n"), TAIL, 10000).alias("x"))
    # Of fewer texts even the most costly one says too little about the share beyond it.
    model.limits = {r["lang"]: r["x"] for r in bars.collect() if (r["texts"] + 1) * (1 - TAIL) >= 1}  # a row a language
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (the share of that language), cross_entropy (nats a symbol) and accepted.

    A null text or one without letters is ``und`` with score 0, without a cross entropy, and not accepted, as is every
    text if the model has no language. Of equal costs the first language by name is taken. Long texts count whole,
    repeated rows are judged alike, all other columns pass through; columns with the names of results are replaced.
    """
    docs = docs.drop("lang_pred", "score", "cross_entropy", "accepted").withColumn("text", F.col("text").cast("string"))
    results = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "accepted": F.lit(False)}
    if not model.languages:
        return docs.withColumns(results)
    costs, n = free_names([*docs.columns, *results], "costs", "n_symbols")
    scored = costs_of(docs, model, costs, n)
    some, best = F.col(n) > 0, F.array_min(costs)
    names = F.array(*[F.lit(x) for x in model.languages])
    lang = F.get(names, F.array_position(costs, best).cast("int") - 1)
    limit = F.get(F.array(*[F.lit(model.limits.get(x, float("inf"))) for x in model.languages]), F.array_position(costs, best).cast("int") - 1)
    cross = best / F.lit(float(UNITS)) / F.col(n)
    return scored.withColumns({
        "lang_pred": F.when(some, lang).otherwise(F.lit(UNKNOWN)), "score": F.when(some, _share(F.col(costs), best, model.rate)).otherwise(0.0),
        "cross_entropy": F.when(some, cross), "accepted": some & ((F.col(n) < MIN_LETTERS) | (cross <= limit)),
    }).drop(costs, n)


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: the CRC-32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by models of the documents that are not held out; a null id teaches nothing."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), F.round("cross_entropy", 6).alias("cross_entropy"), "accepted")
