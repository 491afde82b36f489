"""Sequences derived from text tables: letters stand for bases, everything else is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "".join("ACGT"[i % 26 % 4] for i in range(52))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bases(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, LETTERS, BASES), "[^ACGT]", "")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, seq): ids start at 1, since 0 is no id."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("read_id"), bases(F.col("text")).alias("seq"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_seq_id, seq, left_node, right_node): a path graph over the benchmark passages."""
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1).alias("edge_seq_id"), bases(F.col("text")).alias("seq"), F.col("item_id").cast("int").alias("left_node"), (F.col("item_id") + 1).cast("int").alias("right_node"))


SEQUENCES_SQL = f"""reads AS (
  SELECT doc_id + 1 AS read_id, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents
), edges AS (
  SELECT item_id + 1 AS edge_seq_id, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS seq FROM benchmark
)"""
