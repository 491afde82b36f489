"""Small fixtures of checks, selectors and dumps."""

from __future__ import annotations

import json

import pytest
from readloom.operators import chains, ranking
from readloom.plans import checks, digests, diversity, governance, selectors
from readloom.sources import artifacts, dumps, records
from readloom.sources.records import SCHEMAS


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_order_and_digest(spark):
    r = spark.createDataFrame([("a", 0, 5), ("a", 1, 5), ("b", 0, 3), ("b", 2, 1)], "g string, o int, v int")
    assert rows(checks.order_checks(r, "g", "o", "v")) == [("a", 2, True, True), ("b", 2, False, False)]
    assert checks.digest(r).first() == checks.digest(r.repartition(3, "v")).first() != checks.digest(r.filter("v > 1")).first()
    assert checks.digest(r.limit(0)).first() == (0, "0")
    k = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 1)], "g string, o int, k int")
    assert rows(checks.broken_groups(k, "g", "o", "k")) == [("a", 1, 2)]


def test_places_in_ranges(spark):
    ranges = spark.createDataFrame([(1, 0, 130), (1, 64, 64), (2, 0, 9), (1, 5, 4)], "q int, begin int, end int")
    places = spark.createDataFrame([(1, 0), (1, 64), (1, 64), (1, 130), (1, 131)], "q int, position int")
    assert rows(checks.places_in_ranges(ranges, places, "q", 64)) == [(1, 0, 130, 4), (1, 5, 4, 0), (1, 64, 64, 2), (2, 0, 9, 0)]


def test_attach_fails_closed(spark):
    a, f = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 7)], "k int, edge int")
    assert rows(checks.attach(a.filter("k = 1"), f, ["k"], "edge")) == [(1, 7)]
    with pytest.raises(Exception, match="no fact for"):
        checks.attach(a, f, ["k"], "edge").collect()


def test_samples(spark):
    src = spark.createDataFrame([(1, "ACGTACGTAC"), (2, "ACG")], "source_id long, seq string")
    assert rows(selectors.cut_samples(src, ["x:2:4", "y:1:full"], 4)) == [("x/1", 1, "GTAC"), ("y/1", 1, "CGTACGTAC")]
    for bad in ("x:2", "x:-1:4", "x:0:0", "a b:0:4"):
        with pytest.raises(Exception, match="bad sample"):
            selectors.cut_samples(src, [bad], 4).collect()


def test_pack_plan_order(spark):
    s = spark.createDataFrame([(1, 1, 0, []), (2, 1, 0, []), (3, 3, 0, []), (4, 1, 2, []), (5, 9, 9, ["x"])], "query_id int, raw int, filtered int, reasons array<string>")
    got = selectors.plan_pack(s, 3).select("turn", "query_id")
    assert rows(got) == [(0, 4), (1, 3), (2, 1)]


def slow_diverse(rows, metrics, most, ties, key):
    """All distances anew in every round."""
    low = {m: min(r[m] for r in rows) for m in metrics}
    span = {m: max(r[m] for r in rows) - low[m] or 1 for m in metrics}
    at = {r[key]: [(r[m] - low[m]) / span[m] for m in metrics] for r in rows}
    out = []
    for m in metrics:
        line = sorted(rows, key=lambda r: (r[m], r["query_id"], r[key]))
        for name, r in (("min", line[0]), ("max", line[-1]), ("median", line[len(line) // 2])):
            if len(out) < most and r[key] not in dict(out):
                out.append((r[key], f"{m}_{name}"))
    for n in range(1, min(most, len(rows)) - len(out) + 1):
        left = [r for r in rows if r[key] not in dict(out)]
        near = lambda r: min(sum((a - b) ** 2 for a, b in zip(at[r[key]], at[k], strict=True)) for k, _ in out)
        best = max(left, key=lambda r: (near(r), *(r[t] for t in ties), -abs(r["query_id"]), r["query_id"]))
        out.append((best[key], f"greedy_shape_diversity_{n:02d}"))
    return out


def test_diverse_takes_extremes_then_the_farthest(spark):
    import random

    f = [{"name": f"f{i}", "query_id": i, "m": m} for i, m in enumerate([0, 1, 2, 5, 10])]
    of = lambda rows, *a: [tuple(r)[1:] for r in diversity.diverse(spark.createDataFrame(rows, "name string, query_id long, m long, w long"), *a).orderBy("place").collect()]
    assert of([(r["name"], r["query_id"], r["m"], 0) for r in f], ["m"], 4, ["m"], "name") == [("f0", "m_min"), ("f4", "m_max"), ("f2", "m_median"), ("f3", "greedy_shape_diversity_01")]
    assert of([], ["m"], 4, ["m"], "name") == []
    rng = random.Random(3)
    rows = [{"name": f"n{i}", "query_id": rng.choice([i, -i]), "m": rng.randint(0, 30), "w": rng.choice([1, 2, 64])} for i in range(120)]
    for most in (3, 9, 200):
        some = rows if most < 200 else rows[:12]
        assert of([tuple(r.values()) for r in some], ["m", "w"], most, ["w", "m"], "name") == slow_diverse(some, ["m", "w"], most, ["w", "m"], "name")


def test_recorded_hash_of_canonical_candidates(spark):
    """The six candidates of the join fixture and the hash that is recorded for their file."""
    rows = [(-2, 3, 77, 5, 70, "+"), (-2, 3, 77, 5, 71, "+"), (1, 0, 42, -3, 20, "-"), (1, 0, 42, 2, 10, "+"), (1, 7, 123, -4, 60, "-"), (1, 7, 123, 4, 40, "+")]
    fields = [f.split()[0] for f in SCHEMAS["candidate-record-v1"].split(", ")]
    df = spark.createDataFrame(rows[::-1], SCHEMAS["candidate-record-v1"]).repartition(3).selectExpr("*", "'join' as fixture")
    r = digests.unit_digests(df, "fixture", fields).first()
    assert (r.records, r.sha256) == (6, "c07761a6cf2dca8d2c3d511b938b454d8e272e0f035a147a59674f1c1c2c67ad")
    whole = [digests.whole_digest(digests.unit_digests(d.selectExpr("query_id", *fields[1:]), "query_id", fields), "query_id").first() for d in (df, df.repartition(1), df.filter("target_id != 4"))]
    assert whole[0] == whole[1] and whole[0].units == 2 and whole[0].sha256 != whole[2].sha256
    left, right = digests.unit_digests(df, "query_id", fields), digests.unit_digests(df.filter("target_id != 4"), "query_id", fields)
    diff = governance.pack_diff(left.withColumnRenamed("sha256", "digest"), right.withColumnRenamed("sha256", "digest"), "query_id")
    assert sorted(map(tuple, diff.collect())) == [(-2, "match"), (1, "mismatch")]


def test_ranks_equal_sorted_places(spark):
    import random

    rng = random.Random(6)
    rows = [(i, rng.choice([None, *range(40)]), rng.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "i long, a int, b double").repartition(5)
    got = {r.i: r.place for r in ranking.ranked(df, ["a", df.b.desc(), "i"], "place", 3).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, -r[2], r[0]))
    assert got == {r[0]: k + 3 for k, r in enumerate(want)}
    assert ranking.ranked(df.limit(0), ["i"], "place").count() == 0
    from pyspark.sql import functions as F

    plan = ranking.ranked(df, [F.col("i")], "place")._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_budget_equals_the_fold(spark):
    import random

    rng = random.Random(9)
    for case in range(8):
        rows = [(i * 3, rng.choice([0, 1, 2, 5, 30, 200])) for i in range(rng.choice([1, 20, 300]))]
        most, room = rng.choice([1, 7, 60, 400]), rng.choice([0, 3, 40, 900, 10**6])
        taken, total = [], 0
        for k, n in rows:
            if len(taken) < most and total + n <= room:
                taken.append((k,))
                total += n
        got = governance.budgeted(spark.createDataFrame(rng.sample(rows, len(rows)), "id long, n long"), "id", "n", most, room)
        assert sorted(map(tuple, got.collect())) == taken, case
    assert governance.budgeted(spark.createDataFrame([(None, 1), (1, None)], "id long, n long"), "id", "n", 3, 10).count() == 0


def test_packed_keeps_fixtures_with_null_parameters(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "fixture string, v int")
    params = spark.createDataFrame([("a", None, "x"), ("b", 2, None), ("c", None, "x")], "fixture string, k int, m string")
    assert sorted(map(tuple, governance.packed(rows, params).select("fixture", "v", "param_index").collect())) == [("a", 1, 0), ("b", 2, 1), ("b", 3, 1), ("c", 4, 0)]



def test_boundary_dump(spark, tmp_path):
    names = [c.split()[0] for c in dumps.BOUNDARY.split(", ")]
    body = [[kind, "7", *["1"] * 13, "0.5", "1", *["2.5"] * 4] for kind in dumps.KINDS]
    (tmp_path / "a.tsv").write_text("".join("\t".join(r) + "\n" for r in [["# boundary"], names, *body]))
    d = dumps.split_boundary(dumps.read_headed(spark, str(tmp_path / "a.tsv"), "# boundary", dumps.BOUNDARY))
    assert [d[k].select("query_id", "seq_divergence", "quick_overlap_wall_ms").collect() for k in dumps.KINDS] == [[(7, 0.5, 2.5)]] * 3
    with pytest.raises(Exception, match="not a file of"):
        dumps.read_headed(spark, str(tmp_path / "a.tsv"), "# other", dumps.BOUNDARY).collect()
    with pytest.raises(Exception, match="unknown kind"):
        r = dumps.read_headed(spark, str(tmp_path / "a.tsv"), "# boundary", dumps.BOUNDARY)
        dumps.split_boundary(r.replace("raw_overlap", "odd", "record_type"))["chain_input"].collect()


def test_packs_ledgers_and_validation(spark, tmp_path):
    for q, n in (("query_3", 2), ("query_neg4", 1)):
        (tmp_path / q).mkdir()
        (tmp_path / q / "targets.tsv").write_text("5\t100\n" * n)
    got = dumps.read_pack(spark, str(tmp_path), "targets.tsv", "target")
    assert rows(got) == [(5, 100, -4), (5, 100, 3), (5, 100, 3)]
    stated = spark.createDataFrame([(3, 2), (-4, 3)], "pack_query long, stated long")
    assert rows(dumps.pack_count_faults(got, stated)) == [(-4, 3, 1)]
    (tmp_path / "l.jsonl").write_text('{"query_id": 3, "ms": 1.5}\n\n{"ms": 2.0}\n')
    assert rows(dumps.read_ledger(spark, str(tmp_path / "l.jsonl"), "query_id long, ms double")) == [(3, 1.5)]
    (tmp_path / "v.json").write_text(json.dumps({"fixtures": [{"name": "query_3", "status": "match"}, {"name": "query_neg4", "status": "bad"}, {"name": "x", "status": "match"}]}, indent=1))
    assert rows(dumps.validated_ids(spark, str(tmp_path / "v.json"))) == [(-4, False), (3, True)]


def test_graph_dump_and_labels(spark):
    text = ["Edge 1 a b x x x x x", "Sequence 1 2", "Sequence 1 3", "Edge 2 b c x x x x x", "note", "Sequence 9 9"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "dump string, line_no int, line string")
    g = dumps.graph_records(lines)
    assert rows(g) == [("d", "1", "a", "b", 2), ("d", "2", "b", "c", 0)]
    assert rows(dumps.node_labels(g)) == [("a", "N0000"), ("b", "N0001"), ("c", "N0002")]
    twins = spark.createDataFrame([("1", "a", "b"), ("1", "c", "b")], "edge_id string, start_node string, end_node string")
    assert rows(dumps.node_labels(twins)) == []


def test_logs(spark):
    lines = [("r", "[2024-01-01 00:00:05] INFO: >>>STAGE: assembly"), ("r", "[2024-01-01 00:01:00] INFO: Aligning reads to the graph"), ("r", "[2024-01-01 00:02:30] Aligned read sequence: 1 / 2"), ("r", "no time >>>STAGE: x")]
    assert rows(dumps.log_spans(dumps.log_events(spark.createDataFrame(lines, "run string, line string")))) == [("r", 1, 90)]


def test_nine_digits(spark):
    d = spark.createDataFrame([(0.0,), (-0.0,), (0.1234567891234,), (1e-7,), (1234567890123.0,), (None,)], "v double")
    assert [r[0] for r in d.select(dumps.nine_digits("v")).collect()] == ["0", "0", "0.123456789", "1e-07", "1.23456789e+12", None]


def test_payload_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(q, 0, s, s, s, q, 1, 9, 20, 5, 1, 2, 5, 3, 8, 30, 4, 0.25) for q in (3, -4) for s in (0, 1)], artifacts.BINARY_SCHEMA)
    assert rows(dumps.write_payloads(d, str(tmp_path)).select("query_id", "records")) == [(-4, 2), (3, 2)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["query_3.bin", "query_neg4.bin"]
    assert rows(artifacts.read_payloads(spark, str(tmp_path))) == rows(d)


def test_complement_twice_is_the_same(spark):
    d = spark.createDataFrame([(0, s, 7, 10 * s, 10 * s + 5, 100, 3, 3, 1, 6, 50, 9, 0.1) for s in range(3)], SCHEMAS["read-alignment-v1"])
    once = chains.complement(d)
    assert rows(once.select("segment_id", "read_id", "read_begin", "read_end"))[0] == (0, -7, 74, 79)
    assert rows(chains.complement(once)) == rows(d)


def test_lines_of_one_file_in_several_splits(spark, tmp_path):
    """A file of many splits, one of few lines, and one without a last line end, numbered as they lie."""
    from readloom.sources import ordered

    body = ["# boundary", "b\ta", *(f"{i}\t{'x' * (i % 50)}" for i in range(5000))]
    (tmp_path / "a.tsv").write_text("\n".join(body) + "\n")
    (tmp_path / "b.tsv").write_text("# boundary\na\tb\ny\t-7\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = ordered._lines(spark, str(tmp_path / "a.tsv"))
        assert lines.rdd.getNumPartitions() > 5 and lines.select("block").distinct().count() > 5
        got = {(r.path.rsplit("/", 1)[-1], r.line_no): r.line for r in ordered.numbered_lines(spark, str(tmp_path)).collect()}
        assert got == {("a.tsv", i): x for i, x in enumerate(body)} | {("b.tsv", 0): "# boundary", ("b.tsv", 1): "a\tb", ("b.tsv", 2): "y\t-7"}
        rows = ordered.read_headed(spark, str(tmp_path), "# boundary", "a string, b int").collect()
        assert sorted((r.b, r.a) for r in rows if r.b >= 0) == [(i, "x" * (i % 50)) for i in range(5000)] and len(rows) == 5001
        assert [r.line for r in ordered.first_lines(spark, str(tmp_path / "a.tsv"), 3).collect()] == body[:3]
        assert ordered.first_lines(spark, str(tmp_path / "a.tsv"), 4000).count() == 4000
        (tmp_path / "b.tsv").write_text("# boundary\na\tb\ny\t-7")
        with pytest.raises(ValueError, match="b.tsv"):
            ordered.read_headed(spark, str(tmp_path), "# boundary", "a string, b int")
        (tmp_path / "b.tsv").write_text("# boundary\na\tb\n1\t2\t3\n")
        with pytest.raises(Exception, match="wrong width"):
            ordered.read_headed(spark, str(tmp_path), "# boundary", "a string, b int").collect()
        (tmp_path / "b.tsv").write_text("")
        with pytest.raises(ValueError, match="not a file"):
            ordered.read_headed(spark, str(tmp_path), "# boundary", "a string, b int")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_chain_ids_must_be_contiguous(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("0\t0.015\t1\n1\t0.5\t0\n")
    assert records.read_chain_divergence(spark, str(tmp_path / "d.tsv")).count() == 2
    for bad in ("0\t0.015\t1\n2\t0.5\t0\n", "1\t0.015\t1\n", "0\t0.1\t1\n0\t0.1\t1\n"):
        (tmp_path / "d.tsv").write_text(bad)
        with pytest.raises(ValueError, match="not contiguous"):
            records.read_chain_divergence(spark, str(tmp_path / "d.tsv"))
