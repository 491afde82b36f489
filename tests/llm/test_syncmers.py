"""Likeness of fingerprints: the longest rising sequence against a slow one, and long texts that differ early."""

from __future__ import annotations

import random
import time
from bisect import bisect_left

import pytest

from readloom.llm import syncmers


def rising(x):
    ends = []
    for v in x:
        at = bisect_left(ends, v)
        ends[at : at + 1] = [v]
    return len(ends)


def test_longest_rising_sequences(spark):
    rng = random.Random(3)
    rows = [[], [5], [1, 2, 3], [3, 2, 1]]
    for _ in range(300):
        n = rng.randint(1, 40)
        x = rng.sample(range(200), n)
        for _ in range(rng.randint(0, 3)):  # blocks that rise, in any order
            a = rng.randint(0, n)
            x[a:] = sorted(x[a:])
        rows.append(x)
    df = spark.createDataFrame([(r,) for r in rows], "x array<int>")
    got = [r[0] for r in df.repartition(1).select(syncmers._longest_rising(df.x).alias("n"), "x").collect()]
    want = [rising(r[1]) for r in df.repartition(1).select(syncmers._longest_rising(df.x).alias("n"), "x").collect()]
    assert got == want and len(set(got)) > 10


@pytest.mark.parametrize("edit", ["front", "moved", "swaps"])
def test_a_long_text_with_an_early_edit(spark, edit):
    """400,000 words: fifty more in front; the first half behind the second; and every hundredth pair of blocks swapped."""
    rng = random.Random(7)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400_000)]
    if edit == "front":
        other = [f"x{i}" for i in range(50)] + words
    elif edit == "moved":
        other = words[200_000:] + words[:200_000]
    else:
        blocks = [words[i : i + 100] for i in range(0, len(words), 100)]
        for i in range(0, len(blocks) - 1, 2):
            blocks[i], blocks[i + 1] = blocks[i + 1], blocks[i]
        other = [w for b in blocks for w in b]
    df = spark.createDataFrame([(" ".join(words), " ".join(other))], "a string, b string")
    began = time.time()
    let = syncmers.let
    both = df.select(let(syncmers.hashes(syncmers.fingerprint(df.a)), lambda a: let(syncmers.hashes(syncmers.fingerprint(df.b)), lambda b: syncmers.likeness(a, b))).alias("x"))
    x = both.first().x
    low, high = {"front": (0.999, 1), "moved": (0.32, 0.34), "swaps": (0.3, 0.35)}[edit]
    assert low <= x <= high and time.time() - began < 60
