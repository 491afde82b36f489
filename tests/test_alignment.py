"""From reads to alignments by way of a source pack, and lookups that fail closed."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from readloom.operators import candidates as C
from readloom.operators import chains, grouping
from readloom.plans import alignment
from readloom.sources import dumps

P, G = chains.ChainParams(k=13, min_overlap=40, check_overhang=False), chains.GraphParams(min_overlap=40, max_separation=30)


def back(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def world(spark):
    """Two edges in a row, one repeat in both, and reads of them: over the joint, of the other strand, and of neither."""
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    repeat = dna(30)
    first, second = dna(200) + repeat * 3 + dna(150), dna(180) + repeat * 3 + dna(220)
    noise = lambda s: "".join(rng.choice("ACGT") if rng.random() < 0.03 else c for c in s)
    reads = [(101, noise(first[150:] + second[:150])), (102, noise(back(second[10:200]))), (103, dna(300)), (104, repeat * 2)]
    edges = [(1, first, 10, 11), (2, second, 11, 12)]
    return spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(edges, "edge_seq_id long, seq string, left_node int, right_node int")


def test_a_pack_gives_the_alignments_of_the_reads(spark, world, tmp_path):
    reads, edges = world
    direct = alignment.align_overlaps(alignment.overlap_reads(reads, edges, 4, P), reads, edges, G)
    want = sorted(map(tuple, direct.collect()))
    assert {(r[0], r[1], r[2], r[7]) for r in want} >= {(0, 0, 101, 1), (0, 1, 101, 2), (0, 0, 102, -2)} and not {r[2] for r in want} & {103, 104}
    folder = str(tmp_path / "pack")
    alignment.source_pack(reads, edges, 4, P.k, folder)
    assert dumps.read_pack(spark, f"{folder}/query-minimizers", "part-*", "query-minimizer").filter("is_repetitive = 1 and kmer_freq > 4").count() > 10
    got = alignment.align_pack(spark, folder, reads, edges, P, G)
    assert sorted(map(tuple, got.collect())) == want
    strict = alignment.align_pack(spark, folder, reads, edges, P, G, max_divergence=0.0)
    assert strict.count() == 0


def test_a_hit_in_the_folder_of_another_query_ends_the_job(spark, world, tmp_path):
    reads, edges = world
    alignment.source_pack(reads, edges, 4, P.k, str(tmp_path / "pack"))
    one = next((tmp_path / "pack" / "full-query-hits" / "query_dir=query_101").glob("part-*"))
    one.rename(tmp_path / "pack" / "full-query-hits" / "query_dir=query_102" / "part-99999.csv")
    with pytest.raises(Exception, match="mixed query ids"):
        alignment.align_pack(spark, str(tmp_path / "pack"), reads, edges, P, G).collect()


def test_folders_of_a_pack_follow_the_rows_not_the_queries(spark, world, tmp_path, monkeypatch):
    reads, edges = world
    many = spark.range(33).crossJoin(reads).selectExpr("read_id + 10 * id as read_id", "seq")
    want = sorted(map(tuple, alignment.align_overlaps(alignment.overlap_reads(many, edges, 4, P), many, edges, G).collect()))
    assert len({r[2] for r in want}) == 66
    for rows in (500_000, 1_000):
        monkeypatch.setattr(grouping, "TASK_ROWS", rows)
        folder = tmp_path / f"pack-{rows}"
        alignment.source_pack(many, edges, 4, P.k, str(folder))
        hits, lost = (dumps.read_pack(spark, f"{folder}/{kind}", "part-*", schema) for kind, schema in (("full-query-hits", "full-query-hit"), ("query-minimizers", "query-minimizer")))
        files = [len(list((folder / kind).glob("*/part-*"))) for kind in ("full-query-hits", "query-minimizers")]
        assert max(files) <= max(4, -(-max(hits.count(), lost.count()) // rows)) < 66 and (rows > 1_000 or files[0] > 4)
        assert hits.unionByName(lost, True).filter("pack_query is null or pack_query != query_id").isEmpty()
        assert sorted(map(tuple, alignment.align_pack(spark, str(folder), many, edges, P, G).collect())) == want
    one, other = sorted(p for p in (folder / "full-query-hits").iterdir() if p.is_dir())[:2]
    next(one.glob("part-*")).rename(other / "part-99999.csv")
    with pytest.raises(Exception, match="mixed query ids"):
        alignment.align_pack(spark, str(folder), many, edges, P, G).collect()


def test_missing_lengths_and_edges_end_the_job(spark, world):
    reads, edges = world
    hits = C.candidates(reads, edges, P.k, 4)
    with pytest.raises(Exception, match="no length of"):
        alignment.spans(hits, reads, edges.filter("edge_seq_id = 1"), P).collect()
    with pytest.raises(Exception, match="no length of"):
        alignment.spans(hits, reads.filter("read_id = 102"), edges, P).collect()
    inputs = chains.chain_inputs(alignment.overlap_reads(reads, edges, 4, P))
    with pytest.raises(Exception, match="no edge of id"):
        alignment.bind_edges(inputs, edges.filter("edge_seq_id = 1")).collect()


def test_the_prefilter_knows_overhang(spark, world):
    """A group whose hits leave too much over cannot hold an overlap; it counts to where the last k-mer begins, not ends."""
    reads, edges = world
    hits = C.candidates(reads, edges, P.k, 4)
    kept = {}
    for most in (10_000, 60, 15):
        p = replace(P, check_overhang=True, max_overhang=most)
        groups = alignment.spans(hits, reads, edges, p)
        kept[most] = {(r.query_id, r.target_id) for r in groups.filter("survives").collect()}
        found = {(r.cur_id, r.ext_id) for r in chains.chain_overlaps(hits, alignment.spans(hits, reads, edges, P).filter("survives"), replace(p, max_overhang=most - P.k + 1)).collect()}
        assert found <= kept[most]
    assert kept[15] < kept[10_000]
