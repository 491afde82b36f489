"""Jobs over growing input: what a second run takes, what a cut-off run leaves, and the command line."""

from __future__ import annotations

import json
import logging
import shutil

import pytest
from pyspark.sql import functions as F

from jobs import read_overlaps, selection_plan
from jobs.common import settings
from readloom.plans import planners

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_overlaps_of_arriving_reads(spark, docs, tmp_path, caplog):
    inbox, out, mark, edges = f"{tmp_path}/reads", f"{tmp_path}/out", f"{tmp_path}/mark", f"{SF}/benchmark.parquet"
    docs.filter("doc_id % 2 = 0").coalesce(1).write.parquet(inbox)
    run = lambda: read_overlaps.run(spark, inbox, edges, out, mark)
    with caplog.at_level(logging.INFO):
        first = run()
    assert first["batches"] == 1 and first["reads"] == docs.filter("doc_id % 2 = 0").count() and first["overlaps"] > 0
    assert "wrote" in caplog.text and inbox in caplog.text and out in caplog.text
    one = rows_of(read_overlaps.read_output(spark, out))
    assert run() == {"batches": 0, "reads": 0, "overlaps": 0} and rows_of(read_overlaps.read_output(spark, out)) == one
    docs.filter("doc_id % 2 = 1").withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id"))).coalesce(1).write.mode("append").parquet(inbox)
    second = run()
    assert second["batches"] == 1 and second["reads"] == docs.filter("doc_id % 2 = 1").count()
    found = read_overlaps.read_output(spark, out)
    assert rows_of(found.filter("batch = 0")) == one and found.count() == first["overlaps"] + second["overlaps"]
    whole = f"{tmp_path}/whole"
    read_overlaps.run(spark, f"{SF}/documents.parquet", edges, f"{whole}/out", f"{whole}/mark")  # a path that is one file
    everything = read_overlaps.read_output(spark, f"{whole}/out")
    assert rows_of(everything.filter("cur_id != 2").drop("batch")) == rows_of(found.drop("batch"))
    assert {r.strand for r in everything.select("strand").distinct().collect()} <= {"forward", "reverse"}


def test_a_batch_that_is_run_again_takes_its_place(spark, docs, tmp_path):
    """What a run leaves that ended before its checkpoint knew: the batch's output, without the commit."""
    inbox, out, mark = f"{tmp_path}/reads", f"{tmp_path}/out", f"{tmp_path}/mark"
    docs.write.parquet(inbox)
    read_overlaps.run(spark, inbox, f"{SF}/benchmark.parquet", out, mark)
    before = rows_of(read_overlaps.read_output(spark, out))
    shutil.rmtree(f"{mark}/commits")
    assert read_overlaps.run(spark, inbox, f"{SF}/benchmark.parquet", out, mark)["batches"] == 1
    assert rows_of(read_overlaps.read_output(spark, out)) == before and before


def test_no_overlap_at_all(spark, docs, tmp_path):
    docs.limit(3).withColumn("text", F.lit("a b")).write.parquet(f"{tmp_path}/reads")
    read_overlaps.run(spark, f"{tmp_path}/reads", f"{SF}/benchmark.parquet", f"{tmp_path}/out", f"{tmp_path}/mark")
    assert read_overlaps.read_output(spark, f"{tmp_path}/out").count() == 0


def test_plan_over_a_growing_ledger(spark, tmp_path):
    ledger, out, labels = f"{tmp_path}/ledger", f"{tmp_path}/out", f"{SF}/labels.parquet"
    events = spark.read.parquet(f"{SF}/events.parquet")
    place = events.select("event_id").orderBy("event_id").collect()
    cut = [place[len(place) // 3][0], place[len(place) // 2][0]]
    run = lambda: selection_plan.run(spark, ledger, labels, out)
    total = 0
    for low, high in ((None, cut[0]), (cut[0], cut[1]), (cut[1], None)):
        part = events.filter(" and ".join(["true", *([f"event_id > {low}"] if low is not None else []), *([f"event_id <= {high}"] if high is not None else [])]))
        part.write.mode("append").parquet(ledger)
        got = run()
        total += got["rows"]
        assert got["rows"] == part.count() and got["upto"] == part.agg(F.max("event_id")).first()[0]
        once = rows_of(selection_plan.read_output(spark, out))
        again = run()
        assert again["rows"] == 0 and again["upto"] == got["upto"] and rows_of(selection_plan.read_output(spark, out)) == once
    assert total == events.count()
    whole = f"{tmp_path}/whole"
    selection_plan.run(spark, f"{SF}/events.parquet", labels, whole)
    assert rows_of(selection_plan.read_output(spark, whole)) == once


def test_a_run_that_left_no_mark_is_as_if_it_had_not_been(spark, tmp_path):
    out = f"{tmp_path}/out"
    selection_plan.run(spark, f"{SF}/events.parquet", f"{SF}/labels.parquet", out)
    want = rows_of(selection_plan.read_output(spark, out))
    shutil.rmtree(f"{out}/marks")
    assert selection_plan.run(spark, f"{SF}/events.parquet", f"{SF}/labels.parquet", out)["rows"] > 0
    assert rows_of(selection_plan.read_output(spark, out)) == want


def test_odd_ledger_rows_and_an_empty_ledger(spark, tmp_path):
    schema = "query_id long, place long, selected boolean, supported boolean, ms long"
    rows = [(1, 1, None, True, None), (1, 2, True, True, 5), (None, 3, True, True, 5), (2, None, True, True, 5), (1, 4, None, None, 7)]
    same = {c: c for c in ("query_id", "place", "selected", "supported", "ms")}
    config = settings("selection_plan", {"ledger_columns": same, "allow_unvalidated": True})
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none")
    assert selection_plan.run(spark, f"{tmp_path}/none", f"{SF}/labels.parquet", f"{tmp_path}/out", config)["upto"] is None
    assert selection_plan.read_output(spark, f"{tmp_path}/out").count() == 0
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/ledger")
    got = selection_plan.run(spark, f"{tmp_path}/ledger", f"{SF}/labels.parquet", f"{tmp_path}/out", config)
    assert got["rows"] == 3 and got["upto"] == 4
    r = selection_plan.read_output(spark, f"{tmp_path}/out").first()
    assert (r.query_id, r.observations, r.selected, r.supported, r.later_ms, r.total_ms) == (1, 3, 1, 2, 12, 12)


def test_merged_statistics_are_those_of_all_rows(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5, 6]), i, rng.random() < 0.3, rng.random() < 0.4, rng.randint(0, 9)) for i in range(400)]
    schema = "query_id long, place long, selected boolean, supported boolean, ms long"
    slow = {}
    for q, place, chosen, good, ms in rows:
        s = slow.setdefault(q, [0, 0, 0, place, place, 0, 0, 0])
        s[0], s[1], s[2], s[4], s[5], s[7] = s[0] + 1, s[1] + chosen, s[2] + good, place, s[5] + ms, max(s[7], ms)
        s[6] += ms if s[2] > 1 else 0
    state = spark.createDataFrame([], planners.STATE)
    for a, b in ((0, 3), (3, 20), (20, 20), (20, 400)):
        state = spark.createDataFrame(planners.merge_stats(state, spark.createDataFrame(rows[a:b], schema)).collect(), planners.STATE)
    assert {r[0]: list(r[1:]) for r in state.collect()} == slow


def test_settings_and_command_line(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError, match="unknown settings"):
        settings("read_overlaps", {"kmersize": 3})
    from jobs import common

    seen = {}
    monkeypatch.setattr(common.SparkSession, "stop", lambda self: seen.setdefault("stopped", True))
    (tmp_path / "c.json").write_text(json.dumps({"min_overlap": 60}))
    ran = lambda spark, reads, out, config: seen.update(reads=reads, out=out, config=config) or {}
    assert common.command_line("x", {"reads": "r", "out": "o"}, ran, "read_overlaps", ["--reads", "a", "--out", "b", "--config", str(tmp_path / "c.json"), "--set", "kmer_size=15"]) == 0
    assert seen["stopped"] and (seen["reads"], seen["out"]) == ("a", "b") and (seen["config"]["min_overlap"], seen["config"]["kmer_size"]) == (60, 15)
