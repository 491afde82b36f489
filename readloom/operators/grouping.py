"""Programs over groups of sorted rows, many groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that are sorted or grouped in one task.
TASK_ROWS = 500_000
#: Rows of output that are gathered before they leave a worker.
FLUSH = 20_000


def width_for(rows: int, spark: SparkSession) -> int:
    """Partitions for so many rows, so that a task's memory does not grow with the input; no fewer than the session has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys``, in partitions whose number grows with the rows. Rows are counted: for tables in which they are
    cheap to count."""
    return rows.repartition(width_for(rows.count(), rows.sparkSession), *keys)


def by_group(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, width: int | None = None) -> DataFrame:
    """What ``run`` makes of each group's columns, as arrays in ``order``. Rows move once, by ``keys``, to ``width`` partitions
    if it is stated.

    A group must fit in memory, and groups cost no Arrow batch and no frame of their own. Columns hold no nulls.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def each(columns: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        found = [run({c: v[a:b] for c, v in columns.items()}) for a, b in zip(starts, np.append(starts[1:], len(columns[keys[0]])), strict=True)]
        return {n: np.concatenate([f[n] for f in found]) for n in names}

    return by_groups(rows, keys, order, each, schema, width)


def by_groups(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], schema: str, width: int | None = None, gather: int = 0) -> DataFrame:
    """The same for programs that take many groups at once: the columns of whole groups, one after the other, and where each
    begins. So many groups come together that they have ``gather`` rows, as far as there are."""
    names = [c.split()[0] for c in schema.split(", ")]

    def program(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a group that may go on in the next batch
        whole: list[pa.RecordBatch] = []  # those of groups before it
        waiting = 0
        out: list[dict[str, np.ndarray]] = []
        made = 0

        def flush() -> pa.RecordBatch:
            done = {n: np.concatenate([o[n] for o in out]) for n in names}
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(done[n]) for n in names], names=names)

        def finish(parts: list[pa.RecordBatch]) -> None:
            nonlocal made
            columns = {n: np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i, n in enumerate(parts[0].schema.names)}
            n = len(columns[keys[0]])
            new = np.zeros(n, bool)
            new[0] = True
            for k in keys:
                new[1:] |= columns[k][1:] != columns[k][:-1]
            found = run(columns, np.nonzero(new)[0])
            if len(found[names[0]]):
                out.append(found)
                made += len(found[names[0]])

        key_of = lambda batch, i: tuple(batch.column(k)[i].as_py() for k in keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            last = key_of(batch, batch.num_rows - 1)
            if held and key_of(held[-1], held[-1].num_rows - 1) == last == key_of(batch, 0):
                held.append(batch)
                continue
            at = batch.num_rows - 1  # where the last group of the batch begins
            while at and key_of(batch, at - 1) == last:
                at -= 1
            ended = [*held, *([batch.slice(0, at)] if at else [])]
            whole += ended
            waiting += sum(x.num_rows for x in ended)
            held = [batch.slice(at)]
            if whole and waiting >= gather:
                finish(whole)
                whole, waiting = [], 0
            if made >= FLUSH:
                made = 0
                yield flush()
        if whole or held:
            finish([*whole, *held])
        if out:
            yield flush()

    dealt = rows.repartition(*keys) if width is None else rows.repartition(width, *keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(program, schema)
