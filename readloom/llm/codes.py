"""Operator 11: product codes of vectors by Lloyd rounds that are maintained by differences.

Vectors are integers, cut into PARTS equal stretches; each stretch has a codebook of ENTRIES entries. A round gives every
part its nearest entry and keeps the assignment in a table, with the components of those parts alone whose entry changed.
Running sums and counts of every entry are a table too: a round adds what changed parts bring to their new entry and
takes away what they brought to their old one, summed in the task before it is shuffled. So vectors are read once a round,
and what moves is a row of sums a task, however large the table is.

Vectors and assignments are bucketed by row in the same way, so that a round joins them where they lie. All sums and
distances are whole numbers: results do not depend on the order of rows, on partitions or on tasks that ran twice.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .common import materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components are cut at plus and minus so much, so that sums of squares stay within a long.
LARGEST = 1 << 26
#: Rows of a bucket, about, and the most buckets (a limit of Spark's own).
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 100_000
#: Labels of at most so many values are sent to all executors; of more, those alone with over 1 / HOT_SHARE of the rows.
BROADCAST_LABELS, HOT_SHARE = 1_000_000, 1000
_SLICE = 4096


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``rows`` with the vector as ``whole`` (longs), without those that are null or hold null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    cut = lambda c: F.floor(F.greatest(F.least(F.lit(float(scale)) * c, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    return rows.filter(x.isNotNull() & ~bad).withColumn("whole", F.transform(x, cut))


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of ``width`` components; short ones end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of every part, squared distances summed over parts) of vectors x; books: part, entry, component."""
    parts, _, width = books.shape
    code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
    for a in range(0, len(x), _SLICE):
        some = x[a : a + _SLICE].reshape(-1, parts, width)
        for p in range(parts):
            far = ((some[:, p, None, :] - books[p][None]) ** 2).sum(axis=2)
            best = far.argmin(axis=1)  # the first of equals
            code[a : a + _SLICE, p] = best
            error[a : a + _SLICE] += far[np.arange(len(best)), best]
    return code, error


def _bytes(code: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in code], pa.binary())


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def moves(books: np.ndarray):
    """The program of a round: (row, whole[, code]) to (row, was, code, moved), where moved holds the components of the
    parts whose entry changed, part after part; was is empty in the first round, where all did."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch.column(1), parts * width)
            code, _ = nearest(x, books)
            changed = np.ones(code.shape, bool)
            was = pa.array([b""] * len(code), pa.binary())
            if batch.num_columns > 2:
                changed = _codes(batch.column(2), parts) != code
                was = batch.column(2)
            values = x.reshape(-1, parts, width)[changed].ravel()
            ends = np.concatenate([[0], np.cumsum(changed.sum(axis=1) * width)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), was, _bytes(code), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))], names=["row", "was", "code", "moved"])

    return run


def differences(parts: int, entries: int, width: int):
    """The program that sums what changed parts add and take away: (was, code, moved) to one row an entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            code = _codes(batch.column(1), parts)
            first = np.array([not w for w in batch.column(0).to_pylist()])
            was = code.copy()
            if not first.all():
                was[~first] = _codes(batch.column(0).filter(pa.array(~first)), parts)
            changed = (was != code) | first[:, None]
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
            place = np.broadcast_to(np.arange(parts) * entries, code.shape)
            gone = np.repeat(~first, changed.sum(axis=1))
            for sign, at, v in ((1, (place + code)[changed], values), (-1, (place + was)[changed][gone], values[gone])):
                order = np.argsort(at, kind="stable")
                found, begins = np.unique(at[order], return_index=True)
                if len(found):
                    sums[found] += sign * np.add.reduceat(v[order], begins, axis=0)
                    count += sign * np.bincount(at, minlength=len(count))
        keep = np.nonzero((count != 0) | (sums != 0).any(axis=1))[0]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * width), pa.array(sums[keep].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array((keep // entries).astype(np.int32)), pa.array((keep % entries).astype(np.int32)), pa.array(count[keep]), lists], names=["part", "entry", "n", "sums"])

    return run


class Bucketed:
    """Tables in the shared folder that are bucketed by row, all in the same way; their names go when it ends."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        name = f"codes_{tag}_{uuid.uuid4().hex}"
        self.names.append(name)
        df.write.bucketBy(self.buckets, "row").format("parquet").option("path", scratch_path(self.spark, f"codes-{tag}")).saveAsTable(name)
        return self.spark.table(name)

    def end(self) -> None:
        for name in self.names:  # external tables: their files stay until the driver ends
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def label_sums(coded: DataFrame) -> DataFrame:
    """``coded`` (vec_id, label, code, error) with label_error, the sum of error over equal labels; nulls are one label.

    A label can hold many rows: its sum is made by a partial aggregate, and comes back to rows that stay where they are,
    unless labels are too many for that; then it does for those alone that many rows have.
    """
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "of"), "label-sums")
    by = coded["label"].eqNullSafe(F.col("of"))
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), by).drop("of", "n")
    most = sums.agg(F.sum("n")).first()[0] // HOT_SHARE
    hot = F.broadcast(sums.filter(F.col("n") > most))
    rest = coded.join(hot, by, "left_anti")
    return coded.join(hot, by).drop("of", "n").unionByName(rest.join(sums.filter(F.col("n") <= most), rest["label"].eqNullSafe(F.col("of"))).drop("of", "n"))


def product_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of all vectors, codebooks by part, entry and component).

    Vectors that are null or hold null or non-finite components are left out. Codebooks begin as the vectors of the
    smallest ids that are there (of equal ids, the smaller vector; a null id begins none but is coded); with fewer than
    ``entries`` they are shorter. Vectors shorter than the longest one, and all if its length is no multiple of
    ``parts``, end in zeros. Repeated rows are each coded, other columns are not read, an empty table gives no rows.
    """
    spark = rows.sparkSession
    kept = whole_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), scale)
    n, longest = kept.agg(F.count(F.lit(1)), F.max(F.size("whole"))).first()
    width = max(-(-(longest or 1) // parts), 1)
    start = [r["whole"] for r in kept.filter("vec_id is not null").orderBy("vec_id", "whole").select("whole").limit(entries).collect()]  # bounded: entries
    books = np.zeros((max(len(start), 1), parts * width), np.int64)
    for i, v in enumerate(start):
        books[i, : len(v)] = v
    books = books.reshape(len(books), parts, width).transpose(1, 0, 2).copy()
    buckets = min(max(spark.sparkContext.defaultParallelism, -(-n // BUCKET_ROWS)), MOST_BUCKETS)
    tables = Bucketed(spark, buckets)
    try:
        numbered = kept.select(F.monotonically_increasing_id().alias("row"), "whole", "vec_id", "label")
        vectors = tables.write(numbered.repartition(buckets, "row"), "vectors")
        codes, running = None, None
        for _ in range(rounds):
            now = vectors.select("row", "whole") if codes is None else vectors.select("row", "whole").join(codes.select("row", "code").hint("shuffle_hash"), "row")
            codes = tables.write(now.mapInArrow(moves(books), "row long, was binary, code binary, moved array<long>"), "assigned")
            found = codes.select("was", "code", "moved").filter(F.size("moved") > 0).mapInArrow(differences(parts, books.shape[1], width), "part int, entry int, n long, sums array<long>")
            # The count of an entry is its last place.
            change = found.select("part", "entry", F.posexplode(F.concat("sums", F.array("n"))).alias("place", "v"))
            running = materialize((change if running is None else running.unionByName(change)).groupBy("part", "entry", "place").agg(F.sum("v").alias("v")), "running-sums")
            sums = np.zeros((parts, books.shape[1], width + 1), np.int64)
            for r in running.collect():  # bounded: a row a component of an entry
                sums[r["part"], r["entry"], r["place"]] = r["v"]
            count = sums[:, :, -1:]
            books = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)

        def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code, error = nearest(as_matrix(batch.column(2), parts * width), books)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

        plain = vectors.select("vec_id", "label", "whole")
        coded = materialize(plain.mapInArrow(final, plain.drop("whole").withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema), "coded")
    finally:
        tables.end()
    return coded, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes and errors of all embeddings, with the error of their label and a digest of the codebooks."""
    coded, books = product_codes(table(spark, sf_dir, "embeddings"))
    return label_sums(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(CAST(x AS DOUBLE)), false)), false))""",
        """x AS MATERIALIZED (SELECT vec_id, p, q, v[p * (len(v) // 8) + q + 1] AS x FROM (SELECT vec_id, v, p, unnest(range(0, len(v) // 8)) AS q FROM (SELECT vec_id, v, unnest(range(0, 8)) AS p FROM kept)))""",
        """first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept QUALIFY row_number() OVER (ORDER BY vec_id) <= 16)""",
        """b0 AS MATERIALIZED (SELECT p, j, q, x AS c FROM x JOIN first USING (vec_id))""",
    ]
    for r in range(7):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, j, d FROM (SELECT vec_id, p, j, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN b{r} USING (p, q) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, j) = 1)""")
        if r < 6:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT p, j, q, coalesce(m, c) AS c FROM b{r} LEFT JOIN (
  SELECT p, j, q, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT p, j, q, sum(x) AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id, p) GROUP BY ALL)) USING (p, j, q))""")
    steps.append("coded AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 JOIN kept USING (vec_id) GROUP BY vec_id)")
    steps.append("books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, j, q)) AS s FROM b6)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM coded, books"


ORACLE = {"op11_codes": _oracle()}
