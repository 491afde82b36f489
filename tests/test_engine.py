"""Small fixtures of the record engine."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import dna
from readloom.operators import candidates as C
from readloom.operators.candidates import kmer_join
from readloom.operators.chains import OVERLAP_COLUMNS, ChainParams, GraphParams, chain_read_alignments, overlaps_of, read_alignments
from readloom.plans import alignment, diffs, gates, planners, queries
from readloom.sources import artifacts
from readloom.sources.records import SCHEMAS, violations


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_kmer_join(spark):
    q = spark.createDataFrame([(-2, 3, 77, 77), (1, 0, 42, 42), (1, 5, 99, 99), (1, 7, 123, 321), (1, 11, 500, 500), (2, 9, 999, 999)], SCHEMAS["query-kmer"])
    i = spark.createDataFrame([(77, -2, 3, "-"), (77, 5, 70, "+"), (77, 5, 71, "+"), (42, 1, 0, "+"), (42, -3, 20, "-"), (42, 2, 10, "+"), (99, 1, 5, "+"), (321, -4, 60, "-"), (321, 4, 40, "+"), (500, 8, 80, "+")], SCHEMAS["index"])
    r = spark.createDataFrame([(500,)], "lookup_kmer long")
    assert rows(kmer_join(q, i, r)) == [(-2, 3, 77, 5, 70, "+"), (-2, 3, 77, 5, 71, "+"), (1, 0, 42, -3, 20, "-"), (1, 0, 42, 2, 10, "+"), (1, 7, 123, -4, 60, "-"), (1, 7, 123, 4, 40, "+")]


def test_encoding(spark):
    df = spark.createDataFrame([("CATC",), ("aggg",), ("CGAT",), ("CTGT",)], "s string")
    got = df.select(dna.kmer_encode(df.s, 4), dna.kmer_decode(dna.kmer_encode(df.s, 4), 4), dna.kmer_standard(df.s)).collect()
    assert [tuple(r) for r in got] == [(77, "CATC", "CATC"), (42, "AGGG", "AGGG"), (99, "CGAT", "ATCG"), (123, "CTGT", "ACAG")]


def test_collinear_hits_make_one_overlap():
    p = ChainParams(k=5, min_overlap=20, check_overhang=False)
    got = overlaps_of((1, 100), (2, 100), (range(10, 60), range(13, 63)), [], p)
    (o,) = zip(*(got[c].tolist() for c in OVERLAP_COLUMNS), strict=True)
    assert o[:8] == (1, 11, 63, 100, 2, 14, 66, 100) and o[9] >= 0  # the first hit scores 0, so no chain starts there


def test_repetitive_positions_leave_the_length(spark, monkeypatch):
    rng = random.Random(3)
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    unit = bases(20)
    whole = bases(60) + unit + bases(60)
    edges = spark.createDataFrame([(1, whole)] + [(i, bases(20) + unit + bases(20)) for i in range(2, 12)], "edge_seq_id long, seq string")
    monkeypatch.setattr(queries, "reads", lambda spark, sf: spark.createDataFrame([(100, whole)], "read_id long, seq string"))
    monkeypatch.setattr(queries, "edges", lambda spark, sf: edges)
    (o,) = queries.overlaps(spark, "").collect()
    # Four k-mers lie in the unit, which eleven targets share. A chain program never takes the first hit, at place 0.
    n = len(whole) - 16 - 1 - 4
    assert (o.ext_id, o.cur_begin, o.cur_end) == (1, 1, len(whole) - 1) and abs(o.seq_divergence - math.log((len(whole) - 2 - 4) / n) / 17) < 1e-5


def test_read_alignment_fixture(spark):
    e = spark.createDataFrame([(0, 101, 0, 120, 500, 7, 1, 2, 7001, 10, 130, 1000, 60, 0.01), (1, 101, 130, 260, 500, 8, 2, 3, 8001, 20, 150, 1000, 70, 0.02)], SCHEMAS["edge-overlap"])
    d = spark.createDataFrame([(101, 0, 0.015), (101, 1, 0.5)], "read_id long, chain_id int, divergence double")
    assert rows(read_alignments(chain_read_alignments(e, GraphParams()), d)) == [(0, 0, 101, 0, 120, 500, 7, 7001, 10, 130, 1000, 60, 0.01), (0, 1, 101, 130, 260, 500, 8, 8001, 20, 150, 1000, 70, 0.02)]


def test_planner_fixture(spark):
    led = spark.createDataFrame([(101, 0, False, True, 5), (202, 1, False, True, 7), (101, 2, False, True, 6), (303, 3, False, True, 2), (202, 4, False, True, 9), (303, 5, False, True, 3)], "query_id long, place long, selected boolean, supported boolean, ms long")
    plan = planners.plan_selection(planners.ledger_stats(led), spark.createDataFrame([(101,), (303,)], "query_id long"), spark.createDataFrame([(202,)], "query_id long"))
    assert [(r.query_id, r.later_ms, r.reason) for r in plan.orderBy("rank").collect()] == [(101, 6, None), (303, 3, None), (202, 9, "validation_failed")]


def test_diff_catches_one_lost_row(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert diffs.canonical_diff(a, a).first()["status"] == "match"
    r = diffs.canonical_diff(a, a.distinct()).first()
    assert (r["status"], r["missing"], r["extra"]) == ("mismatch", 1, 0)


def test_violations(spark):
    df = spark.createDataFrame([(1, 0, 5, 2, 0, "+"), (0, 0, 5, 2, 0, "+"), (1, 0, 5, 2, 0, "x")], SCHEMAS["candidate-record-v1"])
    assert sorted(r.broken for r in violations(df, "candidate-record-v1").collect()) == ["id", "strand"]


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 x\nacg\nTT\n\n>r2\r\nGG\r\n>r3\n")
    assert rows(artifacts.read_fasta(spark, str(tmp_path / "a.fasta"))) == [("r1 x", "ACGTT"), ("r2", "GG"), ("r3", "")]
    (tmp_path / "a.gfa").write_text("H\tVN \n\nS\t1\n")
    assert rows(artifacts.read_plain(spark, str(tmp_path / "a.gfa"))) == [("H\tVN",), ("S\t1",)]


def test_binary_payload(spark, tmp_path):
    import numpy as np

    body = np.zeros(2, artifacts.RECORD)
    body["query_id"], body["edge_len"], body["seq_divergence"] = [7, -8], [10, 20], [0.5, 0.25]
    head = np.zeros(1, artifacts.HEADER)
    head["magic"], head["header_bytes"], head["record_bytes"], head["records"], head["mode"] = artifacts.MAGIC, 64, 92, 2, 1
    raw = head.tobytes() + body.tobytes()
    assert artifacts.payload_fault(raw) is None
    assert [artifacts.payload_fault(x) for x in (raw[:10], raw[:-1], b"X" + raw[1:])] == ["header", "length", "magic"]
    (tmp_path / "p.bin").write_bytes(raw)
    got = artifacts.read_payloads(spark, str(tmp_path / "p.bin")).select("query_id", "edge_len", "seq_divergence")
    assert rows(got) == [(-8, 20, 0.25), (7, 10, 0.5)]


def test_gates(spark):
    r = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "q long, e long, v string")
    got = gates.ownership(r, r.filter("e = 0"), r.filter("q = 1"), ["q", "e"], "q")
    assert rows(got.select("v", "decision")) == [("a", "replaced"), ("b", "selected_missing"), ("c", "kept")]
    runs = spark.createDataFrame([("hot", 1, 2.0, 3.0), ("hot", 8, 9.0, 3.0), ("single", 8, 1.0, 3.0)], "mode string, size int, control_ms double, ms double")
    assert rows(gates.crossover(runs)) == [("hot", 8), ("single", None)]


@pytest.mark.parametrize("k", [1, 4, 17, 31])
def test_windows_as_codes_equal_windows_as_text(spark, k):
    """Array programs over batches against text: small letters, other letters, short, empty and null reads, and a long one."""
    rng = random.Random(k)
    bases = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    seqs = [bases(40), bases(40, "acgtACGT"), bases(60, "ACGTACGTN"), "", None, "A" * (k - 1), "A" * k, bases(30) + "éß" + bases(40), "CATG" * 20, bases(C.STEP + 50), bases(33)]
    reads = spark.createDataFrame([(i - 3, s) for i, s in enumerate(seqs)], "read_id long, seq string").coalesce(1)
    code = F.coalesce(F.conv(F.least("own", "other").cast("string"), 4, 10).cast("bigint"), F.lit(0).cast("bigint"))
    text = C._windows(reads, k, "read_id").select("read_id", "pos", code.alias("lookup_kmer"), (F.col("other") < F.col("own")).cast("int").alias("reverse"))
    found = C.lookup_windows(reads, k)
    assert found.dtypes == text.dtypes and found.count() == text.count() > C.STEP
    assert found.exceptAll(text).isEmpty()


def test_reads_are_taken_apart_once(spark):
    """Overlaps come from one pass over the windows of reads, with and without repetitive k-mers."""
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda s: (seen.add(1), s)[1]).asNondeterministic()
    rng = random.Random(8)
    whole = "".join(rng.choice("ACGT") for _ in range(200))
    edges = spark.createDataFrame([(i, whole) for i in range(1, 4)], "edge_seq_id long, seq string")
    reads = spark.createDataFrame([(7, whole)], "read_id long, seq string").withColumn("seq", count("seq"))
    began = seen.value
    hits, often = alignment.found_windows(reads, edges, 5, 17)
    assert hits.count() == 0 and often.count() == 184 and seen.value - began == 1
    hits, often = alignment.found_windows(reads, edges, 6, 17)  # a place on either strand of each
    assert hits.count() == 3 * 184 and often.count() == 0 and seen.value - began == 2
