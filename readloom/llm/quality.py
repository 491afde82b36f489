"""Operator 6: quality by the perplexity of an interpolated modified Kneser-Ney model of character n-grams.

Counts come from all trusted text: each task counts the n-grams of its rows, and the counts are summed by n-gram.
Lower orders, contexts and discounts are aggregates of that table. The probability of every n-gram of the corpus comes
from joins with these count tables, sharded by n-gram, one order after the other. Documents are scored with that table;
a document is rejected when its perplexity is above a high quantile of the trusted documents of its language. For that
quantile no trusted document is scored by its own counts: texts are dealt into ``FOLDS`` parts by hash, and each part is
scored by the model of the others.

N-grams are of characters since the words of these texts are open-ended; a symbol has ``BITS`` bits (characters up to
2047 have one each, others share 2048), so that an n-gram is a long. What an n-gram costs, -ln p, is held in units of
1 / ``UNITS``, so that a document's sum is the same in any order and by either way of joining.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize, returned, table
from .wordhash import parts

ORDER, BITS = 5, 12
VOCABULARY = 1 << BITS
UNITS = 1 << 20
#: The share of a language's trusted documents that stay; documents under MIN_CHARS hold too little to be judged.
QUANTILE, MIN_CHARS = 0.995, 40
#: Parts of the trusted texts, each held out once.
FOLDS = 5
#: Tables of at most so many rows are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_IDS, BROADCAST_GRAMS = 1_000_000, 4_000_000
_FLUSH = 400_000


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram codes of all texts in a row, lengths): one code a character, before the first ones the symbol 0."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.array([len(p) for p in points], np.int64)
    flat = np.zeros(int(lengths.sum()) + (ORDER - 1) * len(texts), np.int64)
    keep = np.ones(len(flat), bool)
    at = 0
    for p in points:
        keep[at : at + ORDER - 1] = False
        at += ORDER - 1
        flat[at : at + len(p)] = p
        at += len(p)
    flat = np.where(flat < VOCABULARY // 2, flat, VOCABULARY // 2 + flat % (VOCABULARY // 2))
    code = flat.copy()
    for i in range(1, ORDER):
        code[i:] |= flat[:-i] << (BITS * i)
    return code[keep], lengths


def chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with a bounded size of text, and their texts."""
    for part in parts(batches, text_at):
        yield part, [t.as_py() or "" for t in part.column(text_at)]


def fold_of(text) -> F.Column:
    """The part that a trusted text is held out in; equal texts share it, so that no copy vouches for another."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, c, parts): every n-gram of ``docs`` (text, fold) with its count in trusted text, which can be 0, and by fold.

    fold: the part of a trusted text, null for others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["gram", *[f"c{f}" for f in range(FOLDS)]]

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return codes, np.stack([np.bincount(at, np.concatenate([x[1][f] for x in held]), len(codes)).astype(np.int32) for f in range(FOLDS)])

        def done(x: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(x[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in (x[0], *x[1])], names=names)

        for part, texts in chunks(batches, 0):
            code, lengths = grams(texts)
            fold = np.repeat(np.array([-1 if f is None else f for f in part.column(1).to_pylist()], np.int64), lengths)
            found, at = np.unique(code, return_inverse=True)
            held.append((found, np.stack([np.bincount(at[fold == f], minlength=len(found)).astype(np.int32) for f in range(FOLDS)])))
            if sum(len(x[0]) for x in held) > _FLUSH:
                held = [merged()]
                if len(held[0][0]) > _FLUSH // 2:
                    yield from done(held.pop())
        if held:
            yield from done(merged())

    each = [f"c{f}" for f in range(FOLDS)]
    found = docs.select("text", "fold").mapInArrow(returned(run), "gram long, " + ", ".join(f"{c} int" for c in each))
    found = found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in each])
    return found.select("gram", sum((F.col(c) for c in each[1:]), F.col(each[0])).alias("c"), *each)


def discounts(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """By model, modified Kneser-Ney discounts from the numbers of n-grams seen once to four times."""
    seen: dict[int, dict[int, int]] = {}
    for r in counts.filter("c between 1 and 4").groupBy("model", "c").agg(F.count(F.lit(1)).alias("n")).collect():  # four rows a model
        seen.setdefault(r["model"], {})[r["c"]] = r["n"]

    def of(found: dict[int, int]) -> tuple[float, float, float]:
        n = [found.get(i, 0) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        return tuple(min(i, max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3))  # type: ignore[return-value]

    return {m: of(seen.get(m, {})) for m in range(FOLDS + 1)}


def _mask(order: int) -> int:
    return (1 << (BITS * order)) - 1


def by_model(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, counts), each (model, gram, c): what every model is to score, and what it counts.

    Model f counts all folds but f and scores the n-grams of fold f; model FOLDS counts and scores all.
    """
    one = lambda m, c, wanted: F.struct(F.lit(m).alias("model"), c.alias("c"), wanted.alias("wanted"))
    folds = [one(f, F.col("c") - F.col(f"c{f}"), F.col(f"c{f}") > 0) for f in range(FOLDS)]
    rows = found.select("gram", F.explode(F.array(*folds, one(FOLDS, F.col("c"), F.lit(True)))).alias("m")).select("m.model", "gram", "m.c", "m.wanted")
    return rows.filter("wanted").drop("wanted"), rows.filter("c > 0").drop("wanted")


def probabilities(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, cost) of every target (model, gram, c), by sharded joins with the counts (model, gram, c) of each order.

    All models go through the same joins. In the result, a gram has its model in the bits above.
    """
    tables: dict[int, DataFrame] = {ORDER: counts}
    for m in range(ORDER - 1, 0, -1):  # in how many contexts of one more symbol it occurs
        tables[m] = materialize(tables[m + 1].groupBy("model", F.col("gram").bitwiseAND(F.lit(_mask(m))).alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"order-{m}")
    now = targets.withColumn("p", F.lit(1.0 / VOCABULARY))
    for m in range(1, ORDER + 1):
        d = discounts(tables[m])
        by = [F.get(F.array(*[F.lit(d[k][i]) for k in range(FOLDS + 1)]), F.col("model")) for i in range(3)]
        cut = F.when(F.col("c") == 1, by[0]).when(F.col("c") == 2, by[1]).otherwise(by[2])
        rows = tables[m].select("model", F.col("gram").alias("g"), F.shiftright("gram", BITS).alias("h"), F.col("c").alias("n"), cut.alias("cut"))
        left = sum((F.count_if(c).cast("double") * F.first(x) for c, x in zip((F.col("n") == 1, F.col("n") == 2, F.col("n") > 2), by, strict=True)), F.lit(0.0))
        context = rows.groupBy("model", "h").agg(F.sum("n").alias("total"), left.alias("left"))
        # Contexts of at most one symbol and single symbols: at most VOCABULARY rows a model, which all executors get.
        few = lambda t, order: F.broadcast(t) if order <= 1 else t  # noqa: B023, E731
        now = now.withColumn("h", F.shiftright("gram", BITS).bitwiseAND(F.lit(_mask(m - 1)))).join(few(context, m - 1), ["model", "h"], "left").drop("h")
        if m < ORDER:
            now = now.withColumn("g", F.col("gram").bitwiseAND(F.lit(_mask(m)))).join(few(rows.select("model", "g", (F.col("n") - F.col("cut")).alias("over")), m), ["model", "g"], "left").drop("g")
        else:
            now = now.withColumn("over", F.when(F.col("c") > 0, F.col("c") - cut))
        p = (F.coalesce("over", F.lit(0.0)) + F.col("left") * F.col("p")) / F.col("total")
        now = now.withColumn("p", F.when(F.col("total").isNull(), F.col("p")).otherwise(p)).drop("over", "total", "left")
    return now.select(coded(F.col("gram"), F.col("model")).alias("gram"), F.round(-F.log("p") * UNITS).cast("long").alias("cost"))


def coded(gram: F.Column, model: F.Column) -> F.Column:
    return gram.bitwiseOR(F.shiftleft(model.cast("long"), BITS * ORDER))


def sent_model(model: DataFrame):
    """The model as sorted arrays on every executor; None if it is too large for that. It comes as Arrow, 16 bytes a row."""
    if model.count() > BROADCAST_GRAMS:
        return None
    rows = model.toArrow()
    codes, cost = rows.column("gram").to_numpy(), rows.column("cost").to_numpy()
    order = np.argsort(codes, kind="stable")
    return model.sparkSession.sparkContext.broadcast((codes[order], cost[order]))


def perplexities(docs: DataFrame, model: DataFrame, sent, which: F.Column) -> DataFrame:
    """``docs`` with perplexity (null without text). model: (gram, cost) with all their n-grams; sent: sent_model of it;
    which: the model of each row."""
    plain = docs.drop("perplexity")
    total, n, own = free_names(plain.columns, "cost_sum", "cost_n", "own_model")
    marked = plain.withColumn(own, which.cast("int"))
    summed = _sums_by_join(marked, model, total, n, own) if sent is None else _sums_sent(marked, sent, total, n, own)
    return summed.withColumn("perplexity", F.when(F.col(n) > 0, F.exp(F.least(F.col(total) / F.lit(float(UNITS)) / F.col(n), F.lit(700.0))))).drop(total, n, own)


def _sums_sent(marked: DataFrame, sent, total: str, n: str, own: str) -> DataFrame:
    """``marked`` with the sum of its n-grams' costs and their number."""
    at, own_at = marked.columns.index("text"), marked.columns.index(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, cost = sent.value
        for part, texts in chunks(batches, at):
            code, lengths = grams(texts)
            code |= np.repeat(part.column(own_at).to_numpy(zero_copy_only=False).astype(np.int64), lengths) << (BITS * ORDER)
            found, back = np.unique(code, return_inverse=True)
            place = np.minimum(np.searchsorted(codes, found), max(len(codes) - 1, 0))
            if len(found) and not (len(codes) and (codes[place] == found).all()):
                raise ValueError("the model lacks n-grams of these documents")
            sums = np.concatenate([[0], np.cumsum(cost[place][back] if len(found) else np.empty(0, np.int64))])
            ends = np.cumsum(lengths)
            none = pa.array(lengths == 0)
            columns = [pc.if_else(none, None, pa.array(x.astype(np.int64))) for x in (sums[ends] - sums[ends - lengths], lengths)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, total, n])

    return marked.mapInArrow(returned(run), marked.withColumns({total: F.lit(None).cast("long"), n: F.lit(None).cast("long")}).schema)


def _sums_by_join(marked: DataFrame, model: DataFrame, total: str, n: str, own: str) -> DataFrame:
    """The same where the model is too large to send: every distinct text's n-grams meet it in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, w, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), batch.column(3), strict=True):
                code, _ = grams([text.as_py() or ""])
                found, m = np.unique(code | (w << (BITS * ORDER)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k1, np.int64)), pa.array(np.full(len(found), k2, np.int64)), pa.array(np.full(len(found), w, np.int32)), pa.array(found), pa.array(m.astype(np.int64))], names=["k1", "k2", "w", "gram", "m"])

    keys = {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), F.reverse("text"))}
    texts = marked.select("text", F.col(own).alias("w")).withColumns(keys).groupBy("k1", "k2", "w").agg(F.first("text").alias("text")).select("k1", "k2", "w", "text")
    sums = texts.mapInArrow(returned(run), "k1 long, k2 long, w int, gram long, m long").join(model, "gram").groupBy("k1", "k2", "w").agg(F.sum(F.col("m") * F.col("cost")).alias("a"), F.sum("m").alias("b"))
    k1, k2 = free_names([*marked.columns, total, n], "k1", "k2")
    return marked.withColumns({k1: keys["k1"], k2: keys["k2"]}).join(sums.toDF(k1, k2, own, total, n), [k1, k2, own], "left").select(*marked.columns, total, n)


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with perplexity, threshold and accepted. trusted: the doc_ids of trusted documents.

    Thresholds come from trusted documents that the model did not see; perplexity is that of the model of all of them.
    A language without trusted documents has no threshold (null), and its documents are accepted; so are null, empty
    and short texts (perplexity is null without text). Null languages count as one. An empty table gives no rows,
    repeated rows and ids are judged alike, long texts count whole. All other columns pass through, whatever their names;
    columns named perplexity, threshold or accepted are replaced.
    """
    docs = docs.drop("perplexity", "threshold", "accepted").withColumn("text", F.col("text").cast("string"))
    ids = materialize(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct(), "trusted")
    few = ids.count() <= BROADCAST_IDS
    known = ids.select(F.col("doc_id").alias("t_id"), F.lit(True).alias("t"))
    marked = docs.select("doc_id", "text", "lang").join(F.broadcast(known) if few else known, F.col("doc_id") == F.col("t_id"), "left")
    marked = marked.select("text", "lang", F.when(F.col("t"), fold_of(F.col("text"))).alias("fold"))
    found = materialize(count_grams(marked), "grams")
    model = materialize(probabilities(*by_model(found)), "model")
    apart = coded(F.lit(0), F.lit(FOLDS))
    held = model.filter(F.col("gram") < apart)
    sent = sent_model(held)
    own = perplexities(marked.filter(F.col("fold").isNotNull() & (F.length("text") >= min_chars)).select("text", "lang", "fold"), held, sent, F.col("fold"))
    bars = materialize(own.groupBy(F.coalesce("lang", F.lit("")).alias("b_lang")).agg(F.percentile_approx("perplexity", quantile, 10000).alias("threshold")), "thresholds")
    (bar,) = free_names([*docs.columns, "perplexity", "threshold"], "b_lang")
    bars = bars.withColumnRenamed("b_lang", bar)
    if sent is not None:
        sent.destroy()
    whole = model.filter(F.col("gram") >= apart)
    scored = perplexities(docs, whole, sent_model(whole), F.lit(FOLDS))
    few = bars.count() <= BROADCAST_IDS
    scored = scored.join(F.broadcast(bars) if few else bars, F.coalesce("lang", F.lit("")) == F.col(bar), "left").drop(bar)
    short = F.length("text") < min_chars
    good = F.col("perplexity").isNull() | F.col("threshold").isNull() | short | (F.col("perplexity") <= F.col("threshold"))
    return scored.withColumn("accepted", F.coalesce(good, F.lit(True)))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic."""
    return table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and decision of all documents, by a model of the trusted ones."""
    judged = judge(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return judged.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "accepted")
