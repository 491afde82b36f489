"""Streams with state: each one is stopped between its batches and started again from its checkpoint."""

from __future__ import annotations

import time

import pytest

from readloom.streaming import requests


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


def run(frame, out, checkpoint):
    frame.writeStream.format("json").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def got(spark, out, schema):
    return sorted(map(tuple, spark.read.schema(schema).json(str(out)).collect()))


def test_a_restarted_stream_answers_each_query_once(spark, tmp_path):
    schema = "query_id long, at timestamp"
    rows = lambda **kind: requests.once(spark.readStream.schema(schema).json(str(tmp_path / "in")), **kind).select("query_id")
    put(tmp_path / "in", "a.json", ['{"query_id": 1, "at": "2024-01-01 00:00:00"}', '{"query_id": 1, "at": "2024-01-01 00:00:01"}', '{"query_id": 2, "at": "2024-01-01 00:00:02"}'])
    for name, kind in (("all", {}), ("bounded", {"at": "at", "delay": "1 hour"})):
        run(rows(**kind), tmp_path / name, tmp_path / f"{name}-mark")
    put(tmp_path / "in", "b.json", ['{"query_id": 2, "at": "2024-01-01 00:10:00"}', '{"query_id": 3, "at": "2024-01-01 00:10:00"}'])
    for name, kind in (("all", {}), ("bounded", {"at": "at", "delay": "1 hour"})):
        run(rows(**kind), tmp_path / name, tmp_path / f"{name}-mark")
        assert got(spark, tmp_path / name, "query_id long") == [(1,), (2,), (3,)]


def test_ordinals_go_on_counting(spark, tmp_path):
    rows = lambda: requests.numbered(spark.readStream.schema("query_id long, place long, request_id long").json(str(tmp_path / "in")), "query_id", "place")
    line = lambda q, p, r: f'{{"query_id": {q}, "place": {p}, "request_id": {r}}}'
    put(tmp_path / "in", "a.json", [line(7, 5, 50), line(7, 2, 20), line(8, 1, 10)])
    run(rows(), tmp_path / "out", tmp_path / "mark")
    put(tmp_path / "in", "b.json", [line(7, 9, 90), line(9, 1, 11)])
    run(rows(), tmp_path / "out", tmp_path / "mark")
    out = got(spark, tmp_path / "out", "query_id long, place long, request_id long, ordinal long, warm boolean")
    assert out == [(7, 2, 20, 0, False), (7, 5, 50, 1, True), (7, 9, 90, 2, True), (8, 1, 10, 0, False), (9, 1, 11, 0, False)]


def test_sessions_claim_answer_fill_up_and_time_out(spark, tmp_path):
    events = lambda: spark.readStream.schema("session_id long, request_id long, place long, kind string").json(str(tmp_path / "in"))
    place = iter(range(100))
    line = lambda s, r, kind="request": f'{{"session_id": {s}, "request_id": {r}, "place": {next(place)}, "kind": "{kind}"}}'
    go = lambda wait: requests.run_sessions(events(), str(tmp_path), str(tmp_path / "mark"), 3, wait).awaitTermination()
    of = lambda name: sorted((r.session_id, r.request_id, r.reason) for r in spark.read.schema(requests.SESSION).json(str(tmp_path / name)).collect())
    put(tmp_path / "in", "a.json", [line(1, 10), line(1, 11), line(1, 10), line(2, 20), line(1, 99, "answer")])
    go("2 seconds")
    assert of("claimed") == [(1, 10, None), (1, 11, None), (2, 20, None)] and of("done") == []
    assert of("errors") == [(1, 10, "claimed twice"), (1, 99, "no such request")]
    time.sleep(2.5)
    put(tmp_path / "in", "b.json", [line(1, 11, "answer"), line(1, 12), line(1, 13), line(3, 30), line(3, 30, "answer")])
    go("1 hour")
    assert of("claimed") == [(1, 10, None), (1, 11, None), (1, 12, None), (2, 20, None), (3, 30, None)] and of("done") == [(3, 30, None)]
    assert of("errors") == [(1, 10, "claimed twice"), (1, 10, "timeout"), (1, 11, "no such request"), (1, 11, "timeout"), (1, 13, "session is full"), (1, 99, "no such request"), (2, 20, "timeout")]


def test_a_ledger_that_a_retry_does_not_double(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False)], "query_id long, selected boolean")
    path = str(tmp_path / "ledger")
    for batch, mode in ((0, "full-v0"), (1, "selected-only-v0"), (1, "selected-only-v0"), (0, "full-v0")):
        requests.append_ledger(rows, path, mode, batch)
    read = lambda at: sorted(map(tuple, requests.read_session_ledger(spark, at, "query_id long, selected boolean").collect()))
    assert read(path) == [(1, True, 0), (1, True, 1), (2, False, 0)]
    put(tmp_path / "in", "a.json", ['{"query_id": 5, "selected": true}'])
    stream = lambda mark: requests.stream_ledger(spark.readStream.schema("query_id long, selected boolean").json(str(tmp_path / "in")), str(tmp_path / "out"), "full-v0", str(tmp_path / mark)).awaitTermination()
    stream("mark")
    stream("mark")
    stream("other")  # as after a failure before the commit: the same batch again
    assert read(str(tmp_path / "out")) == [(5, True, 0)]
    with pytest.raises(ValueError, match="unknown ledger mode"):
        requests.append_ledger(rows, path, "some", 2)
