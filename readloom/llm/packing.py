"""Operator 2: packing by minimum bin slack.

Documents are tokenized, closed with an end id and cut every ``capacity`` ids; a piece of full capacity is a
sequence by itself. The remaining pieces are gathered into windows; in each window, sequences are filled one after
the other with the multiset of piece lengths whose sum is closest to the capacity. That subset-sum problem is solved
by dynamic programming on bitsets (one Python integer per distinct length), and the counts are read back from the
stored bitsets. What the last sequences of a partition cannot fill is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import returned, table, tokenizer_file

CAPACITY = 2048
END_ID = 1
#: A window closes at so many pieces or so many ids, which bounds a task's memory.
WINDOW_PIECES = 2048
WINDOW_IDS = 2_000_000

# Fixed value: the pre-tokenizer pattern that byte-level vocabularies of this kind use.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class ByteLevelEncoder:
    """Ids exactly as ``tokenizers`` gives them for a byte-level BPE file.

    Where the file is of the plain kind (no normalizer, the pattern above, ids in merge order), texts without its
    special tokens go through the faster ``tiktoken`` core, loaded from the same file; all others through
    ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.fast = None
        if spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.fast = self._core(spec)

    def _core(self, spec: dict):
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in printable}
        to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        try:
            ranks = {bytes(to_byte[c] for c in k): v for k, v in vocab.items()}
        except KeyError:
            return None
        merged = [vocab.get((m if isinstance(m, str) else " ".join(m)).replace(" ", "")) for m in spec["model"]["merges"]]
        if merged != sorted(x for x in merged if x is not None):
            return None
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``capacity``.

    ``reach[i]`` has bit s set if the first i lengths can sum to s. A length with count c is added in binary steps,
    so the bitset takes O(lengths * log c) shifts. Reading back takes as few copies of each length as it can.
    """
    mask = (1 << (capacity + 1)) - 1
    order = sorted(counts, reverse=True)
    reach = [1]
    for length in order:
        bits, left, step = reach[-1], min(counts[length], capacity // length), 1
        while left:
            take = min(step, left)
            bits |= (bits << (take * length)) & mask
            left -= take
            step *= 2
        reach.append(bits)
        if bits >> capacity & 1:
            break
    total = reach[-1].bit_length() - 1
    chosen: dict[int, int] = {}
    for i in range(len(reach) - 1, 0, -1):
        length, n = order[i - 1], 0
        while not reach[i - 1] >> total & 1:
            total -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


class Window:
    """Pieces (doc_id, start, ids, doc_tokens) waiting for a sequence, by length."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.pieces, self.ids = capacity, {}, 0, 0

    def add(self, piece: tuple) -> None:
        n = len(piece[2])
        self.by_length.setdefault(n, []).append(piece)
        self.pieces += 1
        self.ids += n

    def take(self) -> tuple[list[tuple], int]:
        """The pieces of the next sequence, and their length. Earlier pieces of a length go first."""
        chosen = fill({n: len(x) for n, x in self.by_length.items()}, self.capacity)
        out, total = [], 0
        for n, k in sorted(chosen.items(), reverse=True):
            waiting = self.by_length[n]
            out += waiting[:k]
            del waiting[:k]
            if not waiting:
                del self.by_length[n]
            total += n * k
            self.pieces -= k
            self.ids -= n * k
        return out, total


def _sequences(window: Window, last: bool) -> Iterator[list[tuple]]:
    """Full sequences; at the end of the partition, the rest in lengths of powers of two."""
    while window.ids >= window.capacity:
        pieces, total = window.take()
        if total < window.capacity:  # no multiset fits: cut the shortest piece that closes the gap
            gap = window.capacity - total
            n = min((n for n in window.by_length if n > gap), default=None)
            if n is not None:
                doc_id, start, ids, size = window.by_length[n].pop(0)
                if not window.by_length[n]:
                    del window.by_length[n]
                window.pieces -= 1
                window.ids -= n
                pieces.append((doc_id, start, ids[:gap], size))
                window.add((doc_id, start + gap, ids[gap:], size))
        yield pieces
    if last:
        rest = [p for n in sorted(window.by_length, reverse=True) for p in window.by_length[n]]
        room, pieces = 0, []
        left = sum(len(p[2]) for p in rest)
        for doc_id, start, ids, size in rest:
            while len(ids):
                if not room:
                    room = 1 << (left.bit_length() - 1)
                take = min(room, len(ids))
                pieces.append((doc_id, start, ids[:take], size))
                start, ids, room, left = start + take, ids[take:], room - take, left - take
                if not room:
                    yield pieces
                    pieces = []


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, window_pieces: int = WINDOW_PIECES, window_ids: int = WINDOW_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Null text counts as empty (the document is its end id alone); an empty table gives no rows; a very long text is
    cut like any other; rows that repeat a doc_id are separate documents; null doc_ids pass through; other columns
    are not read. One narrow pass: no shuffle, and memory is bounded by a window and the longest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, window = ByteLevelEncoder(tokenizer_path), Window(capacity)
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        size = 0

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence, size
            offset = 0
            for doc_id, start, ids, total in pieces:
                rows.append((doc_id, start, len(ids), total, sequence, offset, ids.tobytes()))
                offset += len(ids)
            size += offset
            sequence += 1

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            columns = list(zip(*rows, strict=True))
            rows, size = [], 0
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    put([(doc_id, start, ids[start : start + capacity], len(ids))])
                if whole < len(ids):
                    window.add((doc_id, whole, ids[whole:], len(ids)))
                if window.pieces >= window_pieces or window.ids >= window_ids:
                    for pieces in _sequences(window, False):
                        put(pieces)
                if size >= 500_000:
                    yield flush()
        for pieces in _sequences(window, True):
            put(pieces)
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(returned(run), PIECE_SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
