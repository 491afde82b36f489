"""Operator 3: line dedup by winnowing.

Lines are of two kinds. Passages that repeat begin and end anywhere in a physical line, so one kind is a run of ``LINE``
words that may start at any word: of every ``WINDOW`` such lines in a row the one with the smallest hash is kept as a
fingerprint, and any two runs of ``RUN = LINE + WINDOW - 1`` equal words share one. Fingerprints are joined by hash to
the positions of all their occurrences; where one repeats, the match is extended both ways with the hashes of all runs
of ``RUN`` words that hold it. The other kind is the physical line of ``MIN_LINE`` words or more: each is a window of its
own, so all of them are fingerprints, and there is nothing to extend. The first occurrence of a run or line, by doc_id
and place, stays; the words of later ones are deleted.

The extension compares a run with the first occurrence of that very run, wherever it is, not with one chosen document:
so the deleted words are exactly those in some run of RUN words, or some line, that occurs before, and copies make no
pairs. Runs and lines are equal when two hashes over different bases are, of 64 and of 32 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, materialize, returned, table
from .wordhash import parts, run_hashes, sliding, span_hashes, whole, words_and_lines

LINE, WINDOW = 25, 26
RUN = LINE + WINDOW - 1
#: Physical lines of fewer words than this stay, however often they are there.
MIN_LINE = 5
#: A table of so many documents' positions is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_DOCS, BROADCAST_POSITIONS = 500_000, 4_000_000
_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def minima(lines: np.ndarray, ok: np.ndarray, full: np.ndarray, window: int) -> np.ndarray:
    """The places of lines that are the smallest of some window of lines in their row (all of equal ones).

    ok: which lines lie in one row; full: which windows do.

    A line is the smallest of a window just when the largest of the minima of all windows around it is its own hash.
    """
    n = len(lines) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = sliding(lines, window, np.minimum)
    low[~full] = 0
    around = np.zeros(n + 2 * (window - 1), np.uint64)
    around[window - 1 : window - 1 + n] = low
    return np.nonzero((sliding(around, window, np.maximum) == lines) & ok)[0]


def low_half(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def line_spans(text: str, min_line: int) -> list[tuple[int, int]]:
    """The first and last word of every physical line with at least ``min_line`` words."""
    out, at = [], 0
    for line in text.split("\n"):
        n = len(_WORD.findall(line))
        if n >= min_line:
            out.append((at, at + n - 1))
        at += n
    return out


def remove_repeats(docs: DataFrame, line: int = LINE, window: int = WINDOW, min_line: int = MIN_LINE) -> DataFrame:
    """``docs`` with what repeats deleted from text, and runs: the deleted stretches as first and last word, from 0.

    Null text stays null, and texts shorter than a run lose repeated lines alone; an empty table gives no rows; long
    texts count whole; of equal texts under two doc_ids all but the first lose all words, or if they are shorter than a
    run all lines of ``min_line`` words; rows equal in doc_id and text are one document and stay alike; null doc_ids come
    after all others. Repeats inside one text count when they do not overlap. All other columns pass through, whatever
    their names; a column named runs is replaced.
    """
    size = line + window - 1
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("k_id"), F.col("text").cast("string").alias("k_text"))
    source = source.filter("k_text is not null")
    # Only where a doc_id repeats does a document need its text's hash beside it.
    alone = source.groupBy("k_id").count().filter("count > 1").isEmpty()
    span = source.agg(F.min("k_id"), F.max("k_id"), F.max(F.octet_length("k_text"))).first()
    tag = (lambda text: F.lit(0).cast("long")) if alone else (lambda text: F.xxhash64(text))
    source = source.withColumn("k_hash", tag(F.col("k_text")))
    # Equal texts: all but the first lose every word, so only the first takes part in what follows.
    digest = F.unhex(F.md5(F.encode("k_text", "UTF-8")))
    digests = materialize(source.select("k_id", "k_hash", digest.alias("digest")), "digests")
    equal = materialize(digests.groupBy("digest").agg(F.min("k_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "head"), "equal-texts")
    copies = digests.join(equal, "digest").filter("k_id != head")
    copies = materialize(copies.select("k_id", "k_hash").distinct(), "copies")
    few = copies.count() <= BROADCAST_DOCS
    source = source.join(F.broadcast(copies) if few else copies, ["k_id", "k_hash"], "left_anti").select("k_id", "k_text", "k_hash")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints of running lines (words 0), and all physical lines with their number of words."""
        for part in parts(batches, 1):
            words, first, words2, starts = words_and_lines(part.column(1))
            lines = run_hashes(words, line)
            at = minima(lines, whole(first, line), whole(first, size), window)
            a, b = starts[:-1], starts[1:]
            long_ones = b - a >= min_line
            a, b = a[long_ones], b[long_ones]
            for h, check, p, n in ((lines[at], None, at, None), (span_hashes(words, a, b), span_hashes(words2, a, b), a, b - a)):
                row = np.searchsorted(first, p, side="right") - 1
                zero = np.zeros(len(p), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(zero if check is None else low_half(check)), part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array((p - first[row]).astype(np.int32)), pa.array(zero if n is None else n.astype(np.int32))],
                    names=["print", "check", "k_id", "k_hash", "place", "words"],
                )

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            words, first, words2, _ = words_and_lines(part.column(1))
            runs, inside, checks = run_hashes(words, size), whole(first, size), low_half(run_hashes(words2, size))
            places = part.column(3)
            counts = np.diff(np.frombuffer(places.buffers()[1], np.int32)[places.offset : places.offset + len(places) + 1])
            begin = np.repeat(first[:-1], counts)
            at = np.array(places.flatten(), np.int64) + begin
            hold = np.zeros(len(runs) + 1, np.int64)  # runs that hold a repeated line
            np.add.at(hold, np.minimum(np.maximum(at - window + 1, begin), len(runs)), 1)
            np.add.at(hold, np.minimum(at + 1, len(runs)), -1)
            at = np.nonzero((np.cumsum(hold)[:-1] > 0) & inside)[0]
            row = np.searchsorted(first, at, side="right") - 1
            for i in range(0, len(at), 100_000):
                a, r = at[i : i + 100_000], row[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs[a].view(np.int64)), pa.array(checks[a]), part.column(0).take(pa.array(r)), part.column(2).take(pa.array(r)), pa.array((a - first[r]).astype(np.int32))],
                    names=["run", "check", "k_id", "k_hash", "place"],
                )

    def checked(positions: DataFrame, column: str) -> DataFrame:
        """A table by document, sent to all executors only while it is small."""
        few = positions.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
        return F.broadcast(positions) if few[0] <= BROADCAST_DOCS and few[1] <= BROADCAST_POSITIONS else positions

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places and lengths of runs and lines as stretches of words that do not touch."""
        for batch in batches:
            out = []
            for spots in batch.column(2):
                v = np.array(spots.values, np.int64)
                a, ends = v >> 32, np.maximum.accumulate((v >> 32) + (v & 0xFFFFFFFF))
                new = np.nonzero(a[1:] > ends[:-1])[0]
                out.append([{"first": x, "last": y - 1} for x, y in zip(a[np.concatenate([[0], new + 1])].tolist(), ends[np.concatenate([new, [len(v) - 1]])].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _RUNS)], names=["k_id", "k_hash", "k_runs"])

    prints = materialize(source.mapInArrow(returned(place), "print long, check int, k_id long, k_hash long, place int, words int"), "prints")
    winnowed, lines = prints.filter("words = 0").select("print", "k_id", "k_hash", "place"), prints.filter("words > 0")
    twice = materialize(winnowed.groupBy("print").count().filter("count > 1").select("print"), "repeated-prints")
    spots = materialize(winnowed.join(twice, "print").groupBy("k_id", "k_hash").agg(F.sort_array(F.collect_list("place")).alias("places")), "spots")
    runs = source.join(checked(spots, "places"), ["k_id", "k_hash"]).select("k_id", "k_text", "k_hash", "places").mapInArrow(returned(extend), "run long, check int, k_id long, k_hash long, place int")
    # The order of occurrences: in one long where ids and places fit, which aggregates without a sort.
    fits = alone and span[0] is not None and 0 <= span[0] and span[1] < 1 << 38 and span[2] < 1 << 24
    here = F.shiftleft("k_id", 24).bitwiseOR(F.col("place").cast("long")) if fits else F.struct("k_id", "k_hash", "place")

    def firsts(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
        """The first occurrence of what is there more than once."""
        return materialize(rows.groupBy(*keys).agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, "first"), tag)

    first_place = F.col("first").bitwiseAND(F.lit((1 << 24) - 1)) if fits else F.col("first.place")
    same = F.shiftright("first", 24) == F.col("k_id") if fits else (F.col("k_id") == F.col("first.k_id")) & (F.col("k_hash") == F.col("first.k_hash"))
    spot = lambda n: F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(n.cast("long")).alias("spot")
    later = runs.join(firsts(runs, ["run", "check"], "first-runs"), ["run", "check"]).filter((here > F.col("first")) & (~same | (F.col("place") >= first_place + size)))
    again = lines.join(firsts(lines, ["print", "check"], "first-lines"), ["print", "check"]).filter(here > F.col("first"))
    gone = later.select("k_id", "k_hash", spot(F.lit(size))).unionByName(again.select("k_id", "k_hash", spot(F.col("words"))))
    cuts = gone.groupBy("k_id", "k_hash").agg(F.sort_array(F.collect_list("spot")).alias("spots"))
    cuts = materialize(cuts.mapInArrow(returned(stretches), "k_id long, k_hash long, k_runs array<struct<first:int,last:int>>"), "cuts")

    plain = docs.drop("runs").withColumn("text", F.col("text").cast("string"))
    key_id, key_hash, key_runs, key_copy = free_names([*plain.columns, "runs"], "k_id", "k_hash", "k_runs", "k_copy")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for text, runs_of, copy in zip(batch.column("text"), batch.column(key_runs).to_pylist(), batch.column(key_copy).to_pylist(), strict=True):
                text = text.as_py()
                stretches = runs_of or []
                if copy:
                    n = len(_WORD.findall(text))
                    stretches = [{"first": a, "last": b} for a, b in ([(0, n - 1)] if n >= size else line_spans(text, min_line))]
                if stretches:
                    spans = [m.span() for m in _WORD.finditer(text)]
                    kept, at = [], 0
                    for s in stretches:
                        kept.append(text[at : spans[s["first"]][0]])
                        at = spans[s["last"] + 1][0] if s["last"] + 1 < len(spans) else spans[-1][1]
                    text = "".join([*kept, text[at:]])
                texts.append(text)
                gone.append(stretches)
            columns = {n: batch.column(n) for n in batch.schema.names if n not in (key_runs, key_copy)}
            columns |= {"text": pa.array(texts, pa.string()), "runs": pa.array(gone, _RUNS)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    names = [*plain.columns, "runs"]
    schema = plain.withColumn("runs", F.lit(None).cast("array<struct<first:int,last:int>>")).schema
    keyed = plain.withColumns({key_id: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), key_hash: tag(F.col("text"))})
    met = keyed.join(checked(cuts, "k_runs").toDF(key_id, key_hash, key_runs), [key_id, key_hash], "left")
    marked = copies.select(F.col("k_id").alias(key_id), F.col("k_hash").alias(key_hash), F.lit(True).alias(key_copy))
    met = met.join(F.broadcast(marked) if few else marked, [key_id, key_hash], "left").drop(key_id, key_hash)
    return met.mapInArrow(returned(cut), schema)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of all documents, and what it takes away."""
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    words = F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    return cleaned.select("doc_id", "text", F.col("runs").cast("string").alias("runs"), words.cast("long").alias("removed_words"))
