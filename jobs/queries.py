"""The jobs as queries over the test tables, and equal DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.plans import queries as engine
from readloom.sources.scratch import shared_dir

from . import read_overlaps, selection_plan


def _new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a call, which stays."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_read_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all documents, as reads, with the benchmark passages, as edges; the second run finds nothing new."""
    at = _new_folder(spark, "read-overlaps")
    for _ in range(2):
        read_overlaps.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{at}/out", f"{at}/checkpoint")
    return read_overlaps.read_output(spark, f"{at}/out").withColumn("seq_divergence", F.round(F.col("seq_divergence").cast("double"), 5))


def job2_selection_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan from all events, as a ledger, and labels, as validation; the second run finds nothing new."""
    out = _new_folder(spark, "selection-plan")
    for _ in range(2):
        selection_plan.run(spark, f"{sf_dir}/events.parquet", f"{sf_dir}/labels.parquet", out)
    return selection_plan.read_output(spark, out)


def queries() -> dict:
    return {"job1_read_overlaps": job1_read_overlaps, "job2_selection_plan": job2_selection_plan}


def oracle_sql() -> dict[str, str]:
    there = engine.oracle_sql()
    return {
        "job1_read_overlaps": there["overlaps"].replace("SELECT * FROM ov", "SELECT *, 0 AS batch, CASE WHEN ext_id > 0 THEN 'forward' ELSE 'reverse' END AS strand FROM ov"),
        "job2_selection_plan": f"SELECT * REPLACE (CAST(rank AS BIGINT) AS rank), coalesce(reason, 'selected') AS decision FROM ({there['selection_plan']})",
    }
