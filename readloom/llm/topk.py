"""Operator 1: exact top-k by inner product, block at a time.

Vectors of whole numbers lie in document ranges; a range is reordered so that like vectors are neighbours and cut into
blocks, each with a forward index (its rows) and, by dimension ("term"), the largest and smallest weight. A query
weighs a block by the sum of its term maxima, an upper bound of any score inside, visits the blocks from the highest
bound down, and stops when a bound falls below its kth score.

Every query first meets one range, by a hash; its kth score there is a floor that it carries to all other ranges, where
blocks whose bounds lie below it are never opened. For that, query batches meet ranges in a grid: batch r and range s
are sent to cell (r, s). Each cell returns at most k rows a query, and these are ranked by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

K = 10
SCALE = 1024
BLOCK = 32
RANGE_ROWS = 8192
BATCH_QUERIES = 4096
_LIMIT = 2.0**62

BLOCK_SCHEMA = "range_id long, ids binary, rows binary, width int, digits string"
CELL_SCHEMA = "query_key long, query_id long, vec_id long, score long, range_id long, scored long, blocks long"


def whole_numbers(vectors: list, scale: int) -> np.ndarray:
    """floor(scale * x) as a matrix; shorter vectors end in zeros; what leaves 62 bits stays at that limit."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.clip(np.floor(out * scale), -_LIMIT, _LIMIT).astype(np.int64)


def packed(m: np.ndarray) -> tuple[bytes, str]:
    most = max(int(m.max(initial=0)), -int(m.min(initial=0)))
    digits = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return m.astype(digits).tobytes(), digits


def neighbours(m: np.ndarray, rows: np.ndarray, block: int) -> list[np.ndarray]:
    """Rows in blocks: halved along the dimension of the largest spread until they fit."""
    if len(rows) <= block or not m.shape[1]:
        return [rows[i : i + block] for i in range(0, len(rows), block)]
    own = m[rows]
    wide = int(own.astype(float).var(axis=0).argmax())
    order = rows[np.argsort(own[:, wide], kind="stable")]
    half = (len(order) // 2 + block - 1) // block * block
    half = half if half < len(order) else len(order) // 2
    return neighbours(m, order[:half], block) + neighbours(m, order[half:], block)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, exactly: in doubles where every sum stays below 2^53, else in Python's integers."""
    if largest(a) * largest(b) * a.shape[-1] < 1 << 53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a.astype(object) @ b.astype(object)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


class Blocks:
    """The blocks of one range, with their term maxima and minima; their rows lie one after the other in one matrix."""

    def __init__(self, frame: pd.DataFrame, width: int):
        own = [np.frombuffer(x, "<i8") for x in frame["ids"]]
        self.ids = np.concatenate(own)
        self.ends = np.cumsum([len(x) for x in own])
        self.starts = self.ends - [len(x) for x in own]
        self.rows = np.zeros((len(self.ids), width), np.int64)
        for a, b, raw, w, digits in zip(self.starts, self.ends, frame["rows"], frame["width"], frame["digits"], strict=True):
            self.rows[a:b, :w] = np.frombuffer(raw, digits).reshape(b - a, w)
        self.high = np.maximum.reduceat(self.rows, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.rows, self.starts, axis=0)
        self.top_weight, self.floats = largest(self.rows), self.rows.astype(float)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """By query and block: the sum over terms of the largest product."""
        return dot(np.maximum(queries, 0), self.high.T) + dot(np.minimum(queries, 0), self.low.T)

    def scores(self, blocks: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the rows of ``blocks``; in doubles where every sum stays below 2^53."""
        at = np.concatenate([np.arange(self.starts[b], self.ends[b]) for b in blocks])
        if self.top_weight * largest(query) * len(query) < 1 << 53:
            return at, (self.floats[at] @ query.astype(float)).astype(np.int64)
        return at, self.rows[at].astype(object) @ query.astype(object)

    def top(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(vec_ids, scores, blocks scored) of the k best rows that reach ``floor``, ties to the smaller id.

        Blocks are opened from the highest bound down, twice as many at each step, as far as their bounds allow then.
        """
        ids, scores, seen, at, step = np.empty(0, np.int64), np.empty(0, bounds.dtype), 0, 0, 1
        order = np.argsort(-bounds, kind="stable")
        while at < len(order):
            least = scores[-1] if len(ids) == k else floor
            now = order[at : at + step]
            if least is not None:
                now = now[bounds[now] >= least]
            if not len(now):
                break
            seen, at, step = seen + len(now), at + step, 2 * step
            rows, got = self.scores(now, query)
            keep = self.ids[rows] != own
            if least is not None:
                keep &= got >= least
            if keep.any():
                ids, scores = np.concatenate([ids, self.ids[rows][keep]]), np.concatenate([scores, got[keep]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
        return ids, scores, seen


def cells(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK, range_rows: int = RANGE_ROWS, batch_queries: int = BATCH_QUERIES) -> DataFrame:
    """(query_key, query_id, vec_id, score, range_id, scored, blocks): the best rows of each query and range that can be
    among its k best, and how many of the range's blocks were scored for it. See exact_topk."""
    spark = vectors.sparkSession
    vec = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vec.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()

        def blocks(ids: list, vecs: list) -> pa.RecordBatch:
            m, ids = whole_numbers(vecs, scale), np.array(ids, "<i8")
            made = []
            for own in neighbours(m, np.argsort(ids, kind="stable"), block):
                raw, digits = packed(m[own])
                made.append((me, ids[own].tobytes(), raw, m.shape[1], digits))
            c = list(zip(*made, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.string())], names=["range_id", "ids", "rows", "width", "digits"])

        ids: list = []
        vecs: list = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vecs += batch.column(1).to_pylist()
            if len(ids) >= 2 * range_rows:
                yield blocks(ids, vecs)
                ids, vecs = [], []
        if ids:
            yield blocks(ids, vecs)

    ranges = max(1, math.ceil(rows.count() / range_rows))
    # A repeated id is cut by its vectors.
    index = materialize(rows.repartitionByRange(ranges, "vec_id", F.xxhash64("vec")).mapInArrow(build, BLOCK_SCHEMA), "topk-blocks")
    ranges = 1 + (index.agg(F.max("range_id")).first()[0] or 0)
    asked = rows.filter(is_query(F.col("vec_id"))).distinct()
    batches = max(1, math.ceil(asked.count() / batch_queries))
    asked = asked.withColumn("query_key", F.xxhash64("vec_id", "vec")).withColumns({"batch": F.pmod("query_key", F.lit(batches)), "home": F.pmod(F.xxhash64("query_key", F.lit(1)), F.lit(ranges))})
    names = [c.split()[0] for c in CELL_SCHEMA.split(", ")]

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            q = whole_numbers(right["vec"].tolist(), scale)
            width = max(q.shape[1], int(left["width"].max()))
            q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
            own = Blocks(left, width)
            bounds = own.bounds(q)
            for i, (key, query_id, floor) in enumerate(zip(right["query_key"].tolist(), right["vec_id"].tolist(), right["floor"].tolist(), strict=True)):
                ids, scores, scored = own.top(q[i], query_id, bounds[i], k, None if pd.isna(floor) else int(floor))
                clipped = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores]
                out.append(pd.DataFrame({"query_key": key, "query_id": query_id, "vec_id": ids, "score": clipped, "range_id": int(left["range_id"].iloc[0]), "scored": scored, "blocks": len(left)}))
        return pd.concat(out)[names] if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in names})

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        columns = ["batch", "range_id", "query_key", "vec_id", "vec", F.col("floor").cast("string").alias("floor")]
        return left.groupBy("batch", "range_id").cogroup(right.select(*columns).groupBy("batch", "range_id")).applyInPandas(cell, CELL_SCHEMA)

    # A query's first range needs no batches: a range meets a share of all queries there.
    none = F.lit(None).cast("long")
    first = materialize(meet(index.withColumn("batch", F.lit(0).cast("long")), asked.withColumns({"batch": F.lit(0).cast("long"), "range_id": F.col("home"), "floor": none})), "topk-home")
    floors = first.groupBy("query_key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    others = asked.withColumn("range_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long")))).filter("range_id != home")
    left = index.withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    return first.unionByName(meet(left, others.join(floors, "query_key", "left"))) if ranges > 1 else first


def exact_topk(vectors: DataFrame, is_query, k: int = K, **options) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows (all, if fewer), ties to the smaller vec_id.

    is_query: a condition on ``id_column``; options: see ``cells``. Rows with a null id, a null vector, or null or
    non-finite components take no part; of vectors of different lengths, what one lacks counts as zero (an empty vector
    scores 0); an empty table gives no rows. Rows that repeat an id are candidates each; for queries with that id all of
    them are the own row, and equal ones are one query. Other columns are not read.
    """
    found = cells(vectors, is_query, k, **options)
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest scores of every vector whose id is divisible by 100, against all others."""
    return exact_topk(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


ORACLE = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
}
