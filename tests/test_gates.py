"""Strict readers, gates that fail closed, and sessions."""

from __future__ import annotations

import json

import pytest
from readloom.functions import dna
from readloom.operators import candidates as C
from readloom.plans import governance, queries
from readloom.sources import dumps, records
from readloom.sources.scratch import shared_dir
from readloom.streaming import requests


def rows(df):
    return sorted(map(tuple, df.collect()))


def file(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_bytes("".join(x + "\n" for x in lines).encode())
    return str(path)


def test_strict_reader(spark, tmp_path):
    good = file(tmp_path, "good", "1\t0\t5\t-2\t7\t+", "-1\t0\t5\t2\t7\t-")
    assert rows(records.read_strict(spark, good, "candidate-record-v1")) == [(-1, 0, 5, 2, 7, "-"), (1, 0, 5, -2, 7, "+")]
    lines = {"1\t0\t5\t2\t7\t+\r": "line-end", "1\t0\t5\t2\t7": "fields", "+1\t0\t5\t2\t7\t+": "number", "01\t0\t5\t2\t7\t+": "number", "99999999999999999999\t0\t5\t2\t7\t+": "number", "0\t0\t5\t2\t7\t+": "id", "1\t-1\t5\t2\t7\t+": "position", "1\t0\t5\t2\t7\t*": "strand"}
    bad = file(tmp_path, "bad", *lines)
    assert {r.line: r.fault for r in records.record_faults(spark, bad, "candidate-record-v1").collect()} == lines
    with pytest.raises(Exception, match="candidate-record-v1: "):
        records.read_strict(spark, bad, "candidate-record-v1").collect()
    with pytest.raises(ValueError, match="no records"):
        records.read_strict(spark, file(tmp_path, "none"), "read", 3)
    assert [r.fault for r in records.record_faults(spark, file(tmp_path, "reads", "1\tACGT", "2\tAC", "3\tACNT"), "read", 3).orderBy("line").collect()] == ["length", "bases"]


def test_window_fixture(spark, tmp_path):
    """String windows give the same hits as encoded ones."""
    q = file(tmp_path, "q", "-2\t3\tCATC", "1\t0\tAGGG", "1\t5\tCGAT", "1\t7\tCTGT", "1\t11\tTTCA", "2\t9\tTTTT")
    i = file(tmp_path, "i", "-2\t3\t-\tCATC", "5\t70\t+\tCATC", "5\t71\t+\tGATG", "1\t0\t+\tAGGG", "-3\t20\t-\tCCCT", "2\t10\t+\tAGGG", "1\t5\t+\tCGAT", "-4\t60\t-\tACAG", "4\t40\t+\tCTGT", "8\t80\t+\tTTCA")
    often = records.read_repetitive(spark, file(tmp_path, "r", "TTCA", "TTCA"), "repetitive-window", 4)
    code = lambda c: dna.kmer_encode(dna.kmer_standard(c), 4).alias("lookup_kmer")
    queries_of = records.read_strict(spark, q, "query-window", 4)
    asked = queries_of.select("query_id", "query_pos", dna.kmer_encode(queries_of.sequence, 4).alias("query_kmer"), code(queries_of.sequence))
    index = records.read_strict(spark, i, "index-window", 4)
    met = C.kmer_join(asked, index.select(code(index.sequence), "target_id", "target_pos", "target_strand"), often.select(code(often.sequence)))
    assert rows(met) == [(-2, 3, 77, 5, 70, "+"), (-2, 3, 77, 5, 71, "+"), (1, 0, 42, -3, 20, "-"), (1, 0, 42, 2, 10, "+"), (1, 7, 123, -4, 60, "-"), (1, 7, 123, 4, 40, "+")]
    assert records.read_repetitive(spark, None).count() == 0


def test_read_windows_fixture(spark):
    """Windows of whole reads against an index of strings: the same hits, one at its place in the read."""
    reads = spark.createDataFrame([(-2, "AAACATCAAA"), (1, "AGGGACGATACTGTATTCA")], "read_id long, seq string")
    index = spark.createDataFrame([(-2, 3, "-", "CATC"), (5, 70, "+", "CATC"), (5, 71, "+", "GATG"), (1, 0, "+", "AGGG"), (-3, 20, "-", "CCCT"), (2, 10, "+", "AGGG"), (1, 5, "+", "CGAT"), (-4, 60, "-", "ACAG"), (4, 40, "+", "CTGT"), (8, 80, "+", "TTCA")], records.SCHEMAS["index-window"])
    w = C.kmer_windows(reads, 4).select("read_id", "pos", dna.kmer_encode(C.F.col("kmer"), 4).alias("query_kmer"), dna.kmer_encode(C.F.col("standard"), 4).alias("lookup_kmer")).toDF("query_id", "query_pos", "query_kmer", "lookup_kmer")
    code = lambda c: dna.kmer_encode(dna.kmer_standard(c), 4).alias("lookup_kmer")
    often = spark.createDataFrame([("TTCA",)], "s string")
    met = C.kmer_join(w, index.select(code(index.sequence), "target_id", "target_pos", "target_strand"), often.select(code(often.s)))
    assert rows(met) == [(-2, 3, 77, 5, 70, "+"), (-2, 3, 77, 5, 71, "+"), (1, 0, 42, -3, 20, "-"), (1, 0, 42, 2, 10, "+"), (1, 10, 123, -4, 60, "-"), (1, 10, 123, 4, 40, "+")]
    codes = C.lookup_windows(reads, 4).join(C.kmer_windows(reads, 4), ["read_id", "pos", "reverse"])
    assert codes.count() == 23 and codes.filter(codes.lookup_kmer != dna.kmer_encode(codes.standard, 4)).count() == 0
    assert codes.filter(dna.code_reverse_complement(codes.lookup_kmer, 4) != dna.kmer_encode(dna.reverse_complement(codes.standard), 4)).count() == 0


def test_hit_sources(spark, tmp_path):
    hits = [(7, n, p, 1, 1, 0, 0, 2, t, q) for n, (t, p, q) in enumerate([(-3, 5, 1), (3, 9, 1), (3, 5, 1), (7, 4, 4), (3, 5, 0)])]
    full = spark.createDataFrame(hits, records.SCHEMAS["full-query-hit"])
    assert [r.source_order for r in records.full_query_hits(full).orderBy("match_order").collect()] == [2, 4, 1, 0]
    with pytest.raises(Exception, match="not replayable"):
        records.full_query_hits(full.withColumn("kmer_freq", C.F.lit(0).cast("long"))).collect()
    path = file(tmp_path, "b", "7\t5\t1\t-3\t1", "7\t9\t1\t3\t1", "7\t5\t1\t3\t1", "7\t4\t1\t7\t4")
    buckets = records.read_in_order(spark, path, "index-bucket")
    name, found = records.source_hits(None, buckets)
    assert name == "minimizer-buckets" and [r.line_no for r in found.orderBy("match_order").collect()] == [2, 1, 0]
    assert records.source_hits(full, buckets)[0] == "full-query-hits"
    assert rows(records.read_sample(spark, path, "index-bucket", 2).select("query_pos")) == [(5,), (9,)]


def test_packs_and_manifests(spark, tmp_path):
    for q in ("query_1", "query_neg2"):
        (tmp_path / q).mkdir()
        for f in dumps.PACK_FILES:
            (tmp_path / q / f).write_text(q + f)
    (tmp_path / "query_neg2" / "query.tsv").unlink()
    files = dumps.pack_files(spark, str(tmp_path))
    assert rows(dumps.missing_pack_files(files)) == [(-2, ["query.tsv"])]
    digests = dumps.pack_digests(files)
    assert rows(governance.pack_diff(digests, digests.filter("pack_query > 0"), "pack_query")) == [(-2, "missing_right"), (1, "match")]
    (tmp_path / "m.json").write_text(json.dumps({"schema": "a", "n": 3}, indent=1))
    assert rows(dumps.read_manifest(spark, str(tmp_path / "m.json"), "schema string, n int", "a")) == [("a", 3)]
    with pytest.raises(Exception, match="not a manifest"):
        dumps.read_manifest(spark, str(tmp_path / "m.json"), "schema string, n int", "b").collect()


def test_canonical_text(spark, tmp_path):
    records.write_canonical(spark.createDataFrame([(2, 0.1234567891234), (1, 0.0), (1, -0.0)], "a int, d double").coalesce(1), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*"))) == "1\t0\n1\t0\n2\t0.123456789\n"


def test_gates_fail_closed(spark):
    li = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "q long, v string")
    chosen = li.filter("q = 1")
    assert rows(governance.verified_substitution(li, li, chosen, "q")) == rows(li)
    with pytest.raises(ValueError, match="differs"):
        governance.verified_substitution(li, governance.without_first(li, ["q", "v"]), chosen, "q")
    with pytest.raises(ValueError, match="audit_metadata_available"):
        governance.require_checks(governance.guard(spark.createDataFrame([("validation_passed", True)], "check string, passed boolean")))
    passed = spark.createDataFrame([(n, True) for n in governance.GUARD_CHECKS], "check string, passed boolean")
    governance.require_checks(governance.guard(passed))
    with pytest.raises(Exception, match="no fact"):
        governance.fill_placeholders(li, chosen.select("q", C.F.lit("x").alias("w")).distinct(), "q", "w").collect()
    assert governance.audit_sample(li, chosen.limit(0), "q").count() == 3 and governance.audit_sample(li, chosen, "q").count() == 2
    assert rows(governance.budgeted(spark.createDataFrame([(1, 5), (2, 9), (3, 4), (4, 1)], "id long, n long"), "id", "n", 3, 10)) == [(1,), (3,), (4,)]


def test_sessions(spark, tmp_path):
    reads = spark.createDataFrame([(1, "AGGGACGATACTGTATTCA" * 3)], "read_id long, seq string")
    targets = spark.createDataFrame([(2, "AGGGACGATACTGTATTCA" * 2)], "edge_seq_id long, seq string")
    reads.write.parquet(str(tmp_path / "in"))
    requests.stream_candidates(spark, str(tmp_path / "in"), targets, str(tmp_path / "out"), str(tmp_path / "cp"), 11, 99).awaitTermination()
    want = rows(C.candidates(reads, targets, 11, 99))
    assert want and rows(spark.read.parquet(str(tmp_path / "out")).drop("batch")) == want
    # The same batch again, as after a failure before its commit: its rows take their own place.
    requests.stream_candidates(spark, str(tmp_path / "in"), targets, str(tmp_path / "out"), str(tmp_path / "cp2"), 11, 99).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("batch")) == want
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox" / "a.jsonl").write_text('{"request_id": 1, "n": 2}\nnonsense\n\n{"n": 3}\n')
    requests.stream_requests(spark, str(tmp_path / "inbox"), str(tmp_path / "done"), str(tmp_path / "errors"), str(tmp_path / "cp3"), "request_id long, n long", lambda df: df.selectExpr("request_id", "n * 2 as m")).awaitTermination()
    assert rows(spark.read.schema("request_id long, m long").json(str(tmp_path / "done")).drop("batch")) == [(1, 4)]
    assert rows(spark.read.schema("line string, error string").json(str(tmp_path / "errors")).drop("batch")) == [("nonsense", "no request"), ('{"n": 3}', "no request")]
    with pytest.raises(ValueError, match="unknown ledger mode"):
        requests.ledger_rows(reads, "some")
    assert requests.once(reads.selectExpr("read_id as query_id").union(reads.selectExpr("read_id"))).count() == 1


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_every_query_with_sql_is_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries())
