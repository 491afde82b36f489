"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch


def tokenizer_file(name: str) -> str:
    """Default place of a public tokenizer file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts are long: rows in an Arrow batch, which lies in memory on both sides of a Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written in the shared folder and read back, see ``scratch``; here with few rows in an Arrow batch."""
    small_batches(df.sparkSession)
    return scratch.materialize(df, tag)


def free_names(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores in front of those that ``columns`` has already (in either case)."""
    there = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in there:
            n = f"_{n}"
        there.add(n.lower())
        out.append(n)
    return out


def returned(program):
    """``program`` over Arrow batches; at its end, memory that it has freed goes back to the system.

    Python workers live on from task to task, and what their allocators hold counts for the executor.
    """

    def run(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from program(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_text(text) -> F.Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
