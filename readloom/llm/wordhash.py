"""Hashes of words and of runs of words for whole Arrow columns at once (numpy, no loop over words)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BASE2 = 0xD6E8FEB86659FD93
_BACK2 = pow(_BASE2, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _SAME.copy()
_LOWER[65:91] += np.uint64(32)
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the longest one so far is kept."""
    if base not in _powers or len(_powers[base]) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _powers[base] = np.cumprod(step, dtype=np.uint64)
    return _powers[base][:n]


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in a column of texts, index of the first word of each row and at last their number).

    Words are runs without ASCII white space; lower: A-Z count as a-z. Nulls have no words.
    """
    raw, offsets, s, e = _words(column)
    return _hashes(raw, s, e, _LOWER if lower else _SAME, _BASE, _BACK), np.searchsorted(s, offsets)


def words_and_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and first words as word_hashes gives them, hashes of the same words by another base, and the index of the
    first word of each line (texts are lines without line feeds; lines without words have the next one's) and their number."""
    raw, offsets, s, e = _words(column)
    first = np.searchsorted(s, offsets)
    lines = np.union1d(first, np.searchsorted(s, np.nonzero(raw == 10)[0]))
    return _hashes(raw, s, e, _SAME, _BASE, _BACK), first, _hashes(raw, s, e, _SAME, _BASE2, _BACK2), lines


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where rows begin and at last end, where words begin, where they end)."""
    column = pc.fill_null(column.cast(pa.string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[raw]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # rows end words as well
    inside = ~space[1:-1]
    s = np.nonzero(inside & (space[:-2] | begins[:-1]))[0]
    e = np.nonzero(inside & (space[2:] | begins[1:]))[0] + 1
    return raw, offsets, s, e


def _hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, codes: np.ndarray, base: int, back: int) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes[raw] * powers(base, len(raw)), dtype=np.uint64, out=sums[1:])
    return mixed((sums[e] - sums[s]) * powers(back, len(raw) + 1)[s])


def span_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of the words from each a up to b, which is not in it; as run_hashes has it for that length."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), dtype=np.uint64, out=sums[1:])
    return mixed((sums[b] - sums[a]) * powers(_BACK, len(words) + 1)[a] + (b - a).astype(np.uint64))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` words in a row (across rows too: see ``whole``)."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), dtype=np.uint64, out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * powers(_BACK, len(words) - size + 1) + np.uint64(size))


def whole(first: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` words: does it lie in one row?"""
    n = int(first[-1]) - size + 1
    if n <= 0:
        return np.empty(0, bool)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[:n] == row[size - 1 :]


def sliding(x: np.ndarray, window: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each window, by doubling."""
    span = 1
    while 2 * span <= window:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (window - span)], x[window - span :]) if window > span else x


def parts(batches: Iterator[pa.RecordBatch], text_at: int, size: int = 600_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``size`` bytes of text, at least a row each."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // size
        cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
