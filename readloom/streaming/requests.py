"""Requests as a file stream: candidate generation over a folder of reads, sessions of request files, and ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.candidates import candidates

LEDGER_MODES = ("full-v0", "selected-only-v0")


def stream_candidates(spark: SparkSession, folder: str, targets: DataFrame, out: str, checkpoint: str, k: int, most: int) -> StreamingQuery:
    """All reads (Parquet: read_id, seq) that are in ``folder`` now, one micro-batch after the other, to ``out``.

    A batch is written to a folder of its own number, so one that runs again takes its own place and doubles nothing.
    """
    reads = spark.readStream.schema("read_id long, seq string").parquet(folder)
    write = lambda batch, n: candidates(batch, targets, k, most).write.mode("overwrite").parquet(f"{out}/batch={n}")
    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_requests(spark: SparkSession, inbox: str, done: str, errors: str, checkpoint: str, schema: str, answer, batch_files: int = 100) -> StreamingQuery:
    """Request files (JSON lines, ``schema`` with request_id) of ``inbox``: what ``answer`` makes of the good ones goes to
    ``done``, lines that do not parse or lack request_id to ``errors``, both in a folder of the batch's number."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", batch_files).load(inbox)

    def session(batch: DataFrame, n: int) -> None:
        parsed = batch.filter("trim(value) != ''").select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("request"))
        good = F.coalesce(F.col("request.request_id").isNotNull(), F.lit(False))
        answer(parsed.filter(good).select("request.*")).write.mode("overwrite").json(f"{done}/batch={n}")
        parsed.filter(~good).select(F.col("value").alias("line"), F.lit("no request").alias("error")).write.mode("overwrite").json(f"{errors}/batch={n}")

    return raw.writeStream.foreachBatch(session).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached_answers(requests: DataFrame, cache: DataFrame, compute) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows): requests (request_key) that the cache (request_key, answer) has take its answer, marked
    cached; the others are computed once a key by ``compute`` and are to be added to the cache."""
    known = cache.select("request_key", F.col("answer"), F.lit(True).alias("cached"))
    fresh = compute(requests.join(cache.select("request_key").distinct(), "request_key", "left_anti").select("request_key").distinct()).select("request_key", "answer")
    answers = requests.join(known.unionByName(fresh.withColumn("cached", F.lit(False))), "request_key")
    return answers, fresh


def ledger_rows(rows: DataFrame, mode: str) -> DataFrame:
    """What a ledger of the mode takes: all rows, or the selected ones alone."""
    if mode not in LEDGER_MODES:
        raise ValueError(f"unknown ledger mode {mode}")
    return rows if mode == "full-v0" else rows.filter("selected")


def append_ledger(rows: DataFrame, path: str, mode: str, batch: int) -> None:
    """Adds the rows of the mode to a ledger of JSON lines, in the folder of a batch; what other batches added stays.

    A batch that is written again takes its own place, so a retry doubles nothing; one that was cut off before its write
    was committed has added nothing.
    """
    ledger_rows(rows, mode).write.mode("overwrite").json(f"{path}/batch={batch}")


def read_session_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a ledger that ``append_ledger`` wrote, with their batch."""
    return spark.read.schema(f"{schema}, batch int").option("basePath", path).json(path)


def stream_ledger(rows: DataFrame, path: str, mode: str, checkpoint: str) -> StreamingQuery:
    """A stream of rows, batch by batch, to a ledger."""
    return rows.writeStream.foreachBatch(lambda batch, n: append_ledger(batch, path, mode, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(ledger: DataFrame, at: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of every query.

    In a stream the queries that were seen are state, which outlives restarts. With ``at``, a time, and ``delay``, a query is
    forgotten when the times of the stream are so far beyond it, so that the state is bounded.
    """
    if at is None or not ledger.isStreaming:
        return ledger.dropDuplicates(["query_id"])
    return ledger.withWatermark(at, delay or "1 hour").dropDuplicatesWithinWatermark(["query_id"])


def numbered(requests: DataFrame, key: str, order: str) -> DataFrame:
    """A stream of requests (``key`` long, ``order`` long, request_id long) with ordinal, the number of earlier requests of
    the key, and warm, whether there was one.

    How many requests a key had is state by key, one number: a stream that is restarted goes on counting. Within a batch the
    requests of a key count in ``order``.
    """

    def run(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values([order, "request_id"])
        n = range(seen, seen + len(rows))
        state.update((seen + len(rows),))
        yield pd.DataFrame({key: of[0], order: rows[order], "request_id": rows["request_id"], "ordinal": list(n), "warm": [i > 0 for i in n]})

    out = f"{key} long, {order} long, request_id long, ordinal long, warm boolean"
    return requests.select(key, order, "request_id").groupBy(key).applyInPandasWithState(run, out, "seen long", "append", GroupStateTimeout.NoTimeout)


SESSION = "session_id long, request_id long, status string, reason string"


def session_states(events: DataFrame, most: int, wait: str) -> DataFrame:
    """What becomes of the requests of sessions: (session_id, request_id, status, reason).

    events: session_id, request_id (longs), place (a long that orders them) and kind, request or answer. A request claims a
    place in its session (status claimed); an answer to a claimed one is done. Errors are a request beyond ``most`` of a
    session (session is full), one that was claimed before (claimed twice), an answer to none (no such request), and a
    claimed request without an answer within ``wait`` (timeout). Sessions are state, so a restarted stream goes on; timers
    are in processing time and run out when the stream is triggered after them.
    """
    limit = int(pd.Timedelta(wait).total_seconds() * 1000)

    def run(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        claimed, ids, until = state.get if state.exists else (0, [], [])
        waiting, out = dict(zip(ids, until, strict=True)), []
        for r, end in list(waiting.items()):
            if end <= now:
                out.append((r, "error", "timeout"))
                del waiting[r]
        rows = list(parts) if not state.hasTimedOut else []
        for r, kind in pd.concat(rows).sort_values("place")[["request_id", "kind"]].itertuples(index=False) if rows else ():
            if kind == "answer":
                out.append((r, "done", None) if waiting.pop(r, None) is not None else (r, "error", "no such request"))
            elif r in waiting:
                out.append((r, "error", "claimed twice"))
            elif claimed >= most:
                out.append((r, "error", "session is full"))
            else:
                claimed += 1
                waiting[int(r)] = now + limit
                out.append((r, "claimed", None))
        state.update((claimed, [int(x) for x in waiting], [int(x) for x in waiting.values()]))
        if waiting:
            state.setTimeoutDuration(max(1, min(waiting.values()) - now))
        yield pd.DataFrame(out, columns=["request_id", "status", "reason"]).assign(session_id=of[0])[["session_id", "request_id", "status", "reason"]]

    kept = "claimed long, ids array<long>, until array<long>"
    return events.select("session_id", "request_id", "place", "kind").groupBy("session_id").applyInPandasWithState(run, SESSION, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_sessions(events: DataFrame, folder: str, checkpoint: str, most: int, wait: str) -> StreamingQuery:
    """A stream of session events (see session_states) to ``claimed``, ``done`` and ``errors`` below ``folder``, as JSON
    lines in a folder of the batch's number."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        for name, status in (("claimed", "claimed"), ("done", "done"), ("errors", "error")):
            batch.filter(F.col("status") == status).write.mode("overwrite").json(f"{folder}/{name}/batch={n}")
        batch.unpersist()

    # With timers, a run over what is there would go on with batches without data and never end.
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark = events.sparkSession
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return session_states(events, most, wait).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, was)
