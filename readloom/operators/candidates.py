"""Candidate generation: k-mer windows, the index, its repetitive part, and the join of queries with the index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import code_reverse_complement, reverse_complement, strand

#: An index of at most so many rows is sent to all executors; a larger one is joined by a shuffle. The same for keys.
BROADCAST_ROWS = 1_000_000
#: Windows that are encoded at once.
STEP = 1 << 18
_DIGITS = np.full(256, 4, np.uint8)
_DIGITS[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2


def _dealt(reads: DataFrame, id_column: str) -> DataFrame:
    """Before rows multiply, reads are dealt out evenly: a file of few partitions would leave the windows to few tasks."""
    spark = reads.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return reads.repartition(width, id_column)


def _windows(reads: DataFrame, k: int, id_column: str) -> DataFrame:
    """(id, pos, own, other): every window of k bases and its reverse complement, as base-4 digits in bytes.

    Digits and complement are made once a read, below the step that multiplies rows: a window's complement is a slice of
    the read's, counted from the other end. Bytes are sliced, not characters, so a window costs O(k) anywhere.
    """
    reads = _dealt(reads.select(id_column, F.upper("seq").alias("seq")).filter(F.length("seq") >= k), id_column)
    both = reads.select(id_column, F.translate("seq", "ACGT", "0123").cast("binary").alias("raw"), F.reverse(F.translate("seq", "ACGT", "3210")).cast("binary").alias("back"))
    at = both.select("*", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - k)).alias("pos"))
    return at.select(id_column, F.col("pos").cast("long").alias("pos"), F.substring("raw", F.col("pos") + 1, F.lit(k)).alias("own"), F.substring("back", F.octet_length("raw") - k - F.col("pos") + 1, F.lit(k)).alias("other"))


def kmer_windows(reads: DataFrame, k: int, id_column: str = "read_id") -> DataFrame:
    """(id, pos, kmer, standard, reverse): every window, the smaller of it and its complement, and is that the latter."""
    text = lambda c: F.translate(c.cast("string"), "0123", "ACGT")
    w = _windows(reads, k, id_column)
    return w.select(id_column, "pos", text(F.col("own")).alias("kmer"), text(F.least("own", "other")).alias("standard"), (F.col("other") < F.col("own")).cast("int").alias("reverse"))


def window_codes(digits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all windows of k digits in a row, and those of their reverse complements: two windows side by side make
    one of both lengths, so a window takes as many steps as k has bits."""
    one = digits.astype(np.int64)
    own, other, n = one, 3 - one, 1
    for bit in bin(k)[3:]:
        own, other, n = (own[:-n] << 2 * n) | own[n:], other[:-n] | (other[n:] << 2 * n), 2 * n
        if bit == "1":
            own, other, n = (own[:-1] << 2) | one[n:], other[:-1] | ((3 - one[n:]) << 2 * n), n + 1
    return own, other


def odd_window_codes(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(lookup_kmer, reverse) of every window of a read with other letters than bases. Such letters are compared as they
    are, and a code has the digits before the first of them."""
    seq = seq.upper()
    raw, back = seq.translate(str.maketrans("ACGT", "0123")).encode(), seq.translate(str.maketrans("ACGT", "3210"))[::-1].encode()
    both = [(raw[i : i + k], back[len(raw) - k - i : len(raw) - i]) for i in range(len(raw) - k + 1)]
    least = [min(x) for x in both]
    codes = [int(x[: len(x) - len(x.lstrip(b"0123"))] or b"0", 4) for x in least]
    return np.array(codes, np.int64), np.array([y < x for x, y in both], np.int32)


def lookup_windows(reads: DataFrame, k: int, id_column: str = "read_id") -> DataFrame:
    """(id, pos, lookup_kmer, reverse): windows with the standard form as a long. Never null, so no join checks that again.

    Codes are array programs over Arrow batches of reads, ``STEP`` windows at once, so that long reads take no more memory.
    """
    kind = reads.schema[id_column].dataType.simpleString()
    names = [id_column, "pos", "lookup_kmer", "reverse"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs = batch.column(0), batch.column(1)
            if seqs.null_count == len(seqs):
                continue
            wide = np.int64 if pa.types.is_large_string(seqs.type) else np.int32
            ends = np.frombuffer(seqs.buffers()[1], wide)[seqs.offset : seqs.offset + len(seqs) + 1].astype(np.int64)
            data = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)
            odd = np.zeros(len(seqs), bool)
            for at in range(int(ends[0]), int(ends[-1]), STEP):
                strange = at + np.nonzero(_DIGITS[data[at : min(at + STEP, int(ends[-1]))]] == 4)[0]
                odd[np.searchsorted(ends, strange, side="right") - 1] = True
            for at in range(int(ends[0]), int(ends[-1]) - k + 1, STEP):
                own, other = window_codes(_DIGITS[data[at : min(at + STEP + k - 1, int(ends[-1]))]], k)
                read = np.repeat(np.arange(len(seqs)), np.diff(np.clip(ends, at, at + len(own))))
                begin = np.arange(at, at + len(own))
                good = (begin + k <= ends[read + 1]) & ~odd[read]
                read, own, other = read[good], own[good], other[good]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(read)), pa.array(begin[good] - ends[read]), pa.array(np.minimum(own, other)), pa.array((other < own).astype(np.int32))], names=names)
            for i in np.nonzero(odd)[0].tolist():
                codes, reverse = odd_window_codes(seqs[i].as_py(), k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(codes), i))), pa.array(np.arange(len(codes))), pa.array(codes), pa.array(reverse)], names=names)

    coded = _dealt(reads.select(id_column, "seq"), id_column).mapInArrow(run, f"`{id_column}` {kind}, pos long, lookup_kmer long, reverse int")
    never_null = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    return coded.select(id_column, never_null("pos", "bigint"), never_null("lookup_kmer", "bigint"), never_null("reverse", "int"))


def kmer_index(targets: DataFrame, k: int, id_column: str = "edge_seq_id") -> DataFrame:
    """(lookup_kmer, reverse, target_id, target_pos, target_strand): both strands of every target; -id is the reverse."""
    ways = targets.select(F.col(id_column).alias("target_id"), "seq").unionByName(targets.select((-F.col(id_column)).alias("target_id"), reverse_complement(F.col("seq")).alias("seq")))
    w = lookup_windows(ways, k, "target_id")
    return w.select("lookup_kmer", "reverse", "target_id", F.col("pos").alias("target_pos"), strand(F.col("target_id")).alias("target_strand"))


def kmer_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("lookup_kmer").agg(F.count(F.lit(1)).alias("kmer_freq"))


def repetitive_kmers(index: DataFrame, most: int) -> DataFrame:
    return kmer_frequency(index).filter(F.col("kmer_freq") > most).select("lookup_kmer")


def unless_large(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked to be sent to all executors only if it is counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kmer_join(queries: DataFrame, index: DataFrame, repetitive: DataFrame, also_on: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of a query k-mer and an index row of one lookup k-mer, as a bag.

    queries: query_id, query_pos, query_kmer, lookup_kmer. Repetitive lookup k-mers are dropped from the index, which is
    the smaller side, so queries move at most once; a hit on the query's own id and place is dropped after the join. The
    output has the query's own k-mer.
    """
    kept = unless_large(index.join(unless_large(repetitive.select("lookup_kmer").distinct()), "lookup_kmer", "left_anti"))
    met = queries.join(kept, ["lookup_kmer", *also_on])
    return met.filter(~((F.col("query_id") == F.col("target_id")) & (F.col("query_pos") == F.col("target_pos")))).select("query_id", "query_pos", F.col("query_kmer").alias("kmer"), "target_id", "target_pos", "target_strand")


def candidates(reads: DataFrame, targets: DataFrame, k: int, most: int) -> DataFrame:
    """candidate-record-v1 of reads against both strands of targets.

    Windows meet the index as longs; a hit's own k-mer is the lookup k-mer or its complement.
    """
    index = kmer_index(targets, k)
    return hits_of_windows(lookup_windows(reads, k), index, repetitive_kmers(index, most), k)


def hits_of_windows(windows: DataFrame, index: DataFrame, repetitive: DataFrame, k: int) -> DataFrame:
    """The same of windows of reads (read_id, pos, lookup_kmer, reverse) and an index."""
    queries = windows.select(F.col("read_id").alias("query_id"), F.col("pos").alias("query_pos"), F.struct("lookup_kmer", "reverse").alias("query_kmer"), "lookup_kmer", "reverse")
    met = kmer_join(queries, index, repetitive, ("reverse",))
    own = F.when(F.col("kmer.reverse") == 0, F.col("kmer.lookup_kmer")).otherwise(code_reverse_complement(F.col("kmer.lookup_kmer"), k))
    return met.withColumn("kmer", own)


def met_windows(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The windows of reads that an index has, with kmer_freq: few beside all windows, which are made once for this."""
    return lookup_windows(reads, k).join(unless_large(kmer_frequency(index)), "lookup_kmer")


def repetitive_positions(reads: DataFrame, targets: DataFrame, k: int, most: int) -> DataFrame:
    """(query_id, position) of every read k-mer that ``candidates`` drops as repetitive."""
    w = lookup_windows(reads, k).select(F.col("read_id").alias("query_id"), F.col("pos").alias("position"), "lookup_kmer")
    return w.join(unless_large(repetitive_kmers(kmer_index(targets, k), most)), "lookup_kmer", "left_semi").select("query_id", F.col("position").cast("int").alias("position"))


def pair_count(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The number of equal pairs, from counts by key: no pair is made."""
    a, b = (x.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((left, "n"), (right, "m")))
    return a.join(b, key).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("matches"))


def minimizers(reads: DataFrame, k: int, window: int) -> DataFrame:
    """(read_id, pos, kmer): the smallest standard k-mer, leftmost first, of every ``window`` k-mers in a row."""
    from pyspark.sql import Window

    w = kmer_windows(reads, k).select("read_id", "pos", F.col("standard").alias("kmer"))
    ahead = Window.partitionBy("read_id").orderBy("pos").rowsBetween(0, window - 1)
    found = w.withColumns({"least": F.min(F.struct("kmer", "pos")).over(ahead), "n": F.count(F.lit(1)).over(ahead)}).filter(F.col("n") == window)
    return found.select("read_id", F.col("least.pos").alias("pos"), F.col("least.kmer").alias("kmer")).distinct()


def group_spans(hits: DataFrame, query_lengths: DataFrame, target_lengths: DataFrame, min_overlap: int, survival: float, max_overhang: int | None = None) -> DataFrame:
    """Count, unique query places and extremes of every (query, target), and whether it can hold an overlap.

    A first hit at place 0 is no change of place, so it does not count as a unique one. A query or target without a length
    ends the job when it is read.
    """
    g = hits.groupBy("query_id", "target_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_distinct(F.when(F.col("query_pos") != 0, F.col("query_pos"))).alias("unique_positions"),
        F.min("query_pos").alias("min_cur"), F.max("query_pos").alias("max_cur"), F.min("target_pos").alias("min_ext"), F.max("target_pos").alias("max_ext"),
    )
    g = g.join(query_lengths, "query_id", "left").join(target_lengths, "target_id", "left")
    lost = lambda c, of: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("no length of "), F.col(of).cast("string"))).cast("int")).otherwise(F.col(c))
    g = g.withColumns({"query_len": lost("query_len", "query_id"), "target_len": lost("target_len", "target_id")})
    ok = (F.col("unique_positions") >= survival * min_overlap) & (F.col("max_cur") - F.col("min_cur") >= min_overlap) & (F.col("max_ext") - F.col("min_ext") >= min_overlap)
    if max_overhang is not None:
        ok &= (F.least("min_cur", "min_ext") <= max_overhang) & (F.least(F.col("query_len") - F.col("max_cur"), F.col("target_len") - F.col("max_ext")) <= max_overhang)
    return g.withColumn("survives", ok)
