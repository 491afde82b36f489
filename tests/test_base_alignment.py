"""Banded edit distances against the full matrix, and divergence of chains on both strands."""

from __future__ import annotations

import random

import numpy as np
import pytest

from readloom.operators import base_alignment, chains


def full_matrix(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, was = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def edited(rng, text, share):
    out = []
    for ch in text:
        r = rng.random()
        out += [] if r < share / 3 else [rng.choice("ACGT"), ch] if r < 2 * share / 3 else [rng.choice("ACGT")] if r < share else [ch]
    return "".join(out)


@pytest.mark.parametrize("band,cells", [(1, 1 << 18), (4, 200), (16, 1 << 18)])
def test_distances_equal_the_full_matrix(monkeypatch, band, cells):
    monkeypatch.setattr(base_alignment, "CELLS", cells)
    rng, pairs = random.Random(band), [("", ""), ("A", ""), ("", "ACGT"), ("ACGT", "ACGT"), ("A" * 60, "C" * 70)]
    for _ in range(150):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90)))
        pairs.append((a, rng.choice([edited(rng, a, 0.1), edited(rng, a, 0.6), a[len(a) // 2 :], "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90)))])))
    codes = lambda t: np.frombuffer(t.encode(), np.uint8)
    got = base_alignment.edit_distances([codes(a) for a, _ in pairs], [codes(b) for _, b in pairs], band)
    assert got.tolist() == [full_matrix(a, b) for a, b in pairs]


def test_long_pairs_need_a_narrow_band_only():
    rng = random.Random(1)
    a = "".join(rng.choice("ACGT") for _ in range(20_000))
    b = edited(rng, a, 0.02)
    codes = lambda t: np.frombuffer(t.encode(), np.uint8)
    d = int(base_alignment.edit_distances([codes(a)], [codes(b)])[0])
    assert 200 < d < 450


def back(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_chain_divergence_on_both_strands(spark):
    rng = random.Random(5)
    edge = "".join(rng.choice("ACGT") for _ in range(300))
    read = edge[20:120] + back(edge)[50:140]
    rows = [(0, 0, 1, 0, 99, len(read), 7, 7, 20, 119, 300, 1, 0.0), (0, 1, 1, 100, 189, len(read), -7, -7, 50, 139, 300, 1, 0.0), (1, 0, 1, 0, 99, len(read), 7, 7, 120, 214, 300, 1, 0.0)]
    found = spark.createDataFrame(rows, chains.ALIGNMENT_SCHEMA)
    reads, edges = spark.createDataFrame([(1, read.lower())], "read_id long, seq string"), spark.createDataFrame([(7, edge)], "edge_seq_id long, seq string")
    got = {r.chain_id: r for r in base_alignment.chain_divergence(found, reads, edges).collect()}
    assert (got[0].edits, got[0].bases, got[0].divergence) == (0, 190, 0.0)
    assert (got[1].edits, got[1].bases) == (full_matrix(read[:100], edge[120:215]), 100) and got[1].divergence > 0.25
    kept = chains.read_alignments(found, base_alignment.chain_divergence(found, reads, edges))
    assert sorted((r.chain_id, r.segment_id) for r in kept.collect()) == [(0, 0), (0, 1)]
    for wrong_reads, wrong_edges in ((reads.limit(0), edges), (reads, edges.limit(0)), (reads.withColumn("seq", reads.seq.substr(1, 50)), edges)):
        with pytest.raises(Exception, match="no (read|edge)_seq"):
            base_alignment.chain_divergence(found, wrong_reads, wrong_edges).collect()
