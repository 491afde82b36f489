"""Base-level divergence of chains: edit distances of read and edge stretches within a band that grows as far as it must."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from .candidates import unless_large

#: The first band reaches so far beyond the difference of lengths; cells of all bands in one array program.
BAND, CELLS = 16, 1 << 18
_FAR = np.int32(1 << 29)


def _within(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distances of pairs of which no path leaves the band, row by row for all pairs at once; else too large ones."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = 2 * band + 1
    rows = int(n.max(initial=0))
    left, right = np.full((len(a), rows), 254, np.uint8), np.full((len(a), rows + width), 255, np.uint8)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        left[k, : len(x)] = x
        right[k, band : band + len(y)] = y
    step = np.arange(width, dtype=np.int32)
    now = np.broadcast_to(np.where(step >= band, step - band, _FAR), (len(a), width)).astype(np.int32)
    found = np.where(n == 0, m, 0).astype(np.int64)
    at = m - n + band  # the cell of both ends
    for i in range(1, rows + 1):
        best = now + (left[:, i - 1 : i] != right[:, i - 1 : i - 1 + width])
        np.minimum(best[:, :-1], now[:, 1:] + 1, out=best[:, :-1])
        if i <= band:  # nothing lies before the begin of b
            best[:, : band - i] = _FAR
            best[:, band - i] = i
        # A step along b costs one: the least of what lies before, and the way from there.
        now = np.minimum.accumulate(best - step, axis=1) + step
        done = n == i
        if done.any():
            found[done] = now[done, at[done]]
    return found


def edit_distances(a: list[np.ndarray], b: list[np.ndarray], band: int = BAND) -> np.ndarray:
    """The edit distance of every pair of code arrays.

    A path of cost d strays at most d from the diagonal, so a distance within the band is the distance; pairs with a larger
    one go on with twice the band. Pairs of one width are gathered by length until their bands have ``CELLS`` cells.
    """
    out = np.zeros(len(a), np.int64)
    open_now = [(abs(len(x) - len(y)) + band, k) for k, (x, y) in enumerate(zip(a, b, strict=True))]
    while open_now:
        again = []
        order = sorted(open_now, key=lambda o: (o[0].bit_length(), len(a[o[1]])))
        i = 0
        while i < len(order):
            j, wide = i, 0
            while j < len(order) and order[j][0].bit_length() == order[i][0].bit_length() and (j == i or (j - i + 1) * (2 * max(wide, order[j][0]) + 1) <= CELLS):
                wide = max(wide, order[j][0])
                j += 1
            ks = [k for _, k in order[i:j]]
            for k, d in zip(ks, _within([a[k] for k in ks], [b[k] for k in ks], wide).tolist(), strict=True):
                out[k] = d
                if d > wide:
                    again.append((2 * wide, k))
            i = j
        open_now = again
    return out


def stretch(seq: Column, begin: Column, end: Column, forward: Column) -> Column:
    """The bases from ``begin`` to ``end``, both included, of a sequence or of its reverse complement."""
    own = F.substring(seq, begin + 1, end - begin + 1)
    return F.when(forward, own).otherwise(reverse_complement(F.substring(seq, F.length(seq) - end, end - begin + 1)))


def chain_divergence(alignments: DataFrame, reads: DataFrame, edges: DataFrame) -> DataFrame:
    """(read_id, chain_id, edits, bases, divergence) of chains of segments (read-alignment-v1).

    edits: the edit distances of all segments' read and edge stretches; bases: the lengths of the longer ones; divergence:
    edits by bases. reads: read_id, seq; edges: edge_seq_id, seq; negative ids are the reverse strand. A segment whose
    sequence is not there, or is too short for it, ends the job. Only the stretches go to Python, a row a segment.
    """
    of_read = reads.select(F.col("read_id").alias("own_read"), F.upper("seq").alias("read_seq"))
    of_edge = edges.select(F.col("edge_seq_id").alias("own_edge"), F.upper("seq").alias("edge_seq"))
    met = alignments.select("read_id", "chain_id", "read_begin", "read_end", "edge_seq_id", "edge_begin", "edge_end")
    met = met.join(unless_large(of_edge), F.abs("edge_seq_id") == F.col("own_edge"), "left").join(of_read, F.abs("read_id") == F.col("own_read"), "left")

    def checked(seq: str, begin: str, end: str, id_: str) -> Column:
        there = F.col(seq).isNotNull() & (F.col(begin) >= 0) & (F.col(end) < F.length(seq)) & (F.col(begin) <= F.col(end) + 1)
        return F.when(there, stretch(F.col(seq), F.col(begin), F.col(end), F.col(id_) > 0)).otherwise(F.raise_error(F.concat(F.lit(f"no {seq} for the segment of "), F.col(id_).cast("string"))))

    pairs = met.select("read_id", "chain_id", checked("read_seq", "read_begin", "read_end", "read_id").alias("a"), checked("edge_seq", "edge_begin", "edge_end", "edge_seq_id").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = lambda column: [np.frombuffer(x.as_py().encode(), np.uint8) for x in column]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                a, b = codes(part.column(2)), codes(part.column(3))
                longer = [max(len(x), len(y)) for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(edit_distances(a, b)), pa.array(longer, pa.int64())], names=["read_id", "chain_id", "edits", "bases"])

    each = pairs.mapInArrow(run, "read_id long, chain_id int, edits long, bases long")
    return each.groupBy("read_id", "chain_id").agg(F.sum("edits").alias("edits"), F.sum("bases").alias("bases")).withColumn("divergence", F.when(F.col("bases") > 0, F.col("edits") / F.col("bases")).otherwise(0.0))
