"""Which queries a next session should take over, from a ledger that grows.

The ledger has a row an observation, with its place in a total order. A run reads the rows beyond the high-water mark alone,
adds them to the statistics by query that the run before it left, and plans anew: queries with a reason against them, and
the rank of all. The plan is written by decision. Statistics lie in a folder of their mark, and the mark is written after
them; a run that was cut off before that is as if it had not been, and one that finds nothing new leaves the same plan.

    python -m jobs.selection_plan --ledger PATH --validation PATH --out DIR [--config FILE] [--set NAME=JSON]

Rows without a query or a place are counted in the log and left out; a row that comes late, at or below the mark, is never
read, so places must be given in order. Unknown flags (null) count as false, times as 0.
"""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.plans.planners import STATE, merge_stats, plan_selection
from readloom.sources.scratch import materialize

from .common import command_line, log_of, read_table, settings

NAME = "selection_plan"
SCHEMA = f"{STATE}, reason string, rank long, decision string"
MARKS = "upto long, ledger_rows long, queries long"


def high_water_mark(spark: SparkSession, out: str) -> int | None:
    """The place up to which the ledger was taken; None before the first run."""
    try:
        return spark.read.schema(MARKS).json(f"{out}/marks").agg(F.max("upto")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run(spark: SparkSession, ledger: str, validation: str, out: str, config: dict | None = None) -> dict:
    """Takes the new rows of ``ledger`` and writes the plan; how many rows and queries that were, and the new mark."""
    config, log = config or settings(NAME), log_of(NAME)
    mark = high_water_mark(spark, out)
    rows = read_table(spark, ledger, config["ledger_format"], config["ledger_columns"])
    new = rows if mark is None else rows.filter(F.col("place").isNull() | (F.col("place") > mark))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    good = new.filter(F.col("query_id").isNotNull() & F.col("place").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("place").cast("long").alias("place"), flag("selected"), flag("supported"), F.coalesce(F.col("ms").cast("long"), F.lit(0)).alias("ms"))
    upto, taken, seen = new.agg(F.max(F.when(F.col("query_id").isNotNull(), F.col("place"))), F.count_if(F.col("query_id").isNotNull() & F.col("place").isNotNull()), F.count(F.lit(1))).first()
    state = spark.createDataFrame([], STATE) if mark is None else spark.read.schema(STATE).parquet(f"{out}/state/upto={mark}")
    if upto is not None:
        # Rows that arrive while this runs are left to the next run.
        merge_stats(state, good.filter(F.col("place") <= upto)).write.mode("overwrite").parquet(f"{out}/state/upto={upto}")
        state = spark.read.schema(STATE).parquet(f"{out}/state/upto={upto}")
        queries = state.count()
        spark.createDataFrame([(upto, taken, queries)], MARKS).coalesce(1).write.mode("overwrite").json(f"{out}/marks/mark={upto}")
        log.info("read %d new rows of %s (%d without a query or a place), wrote the statistics of %d queries up to %d", taken, ledger, seen - taken, queries, upto)
    else:
        log.info("nothing new in %s beyond %s", ledger, mark)
    states = read_table(spark, validation, config["validation_format"], config["validation_columns"]).filter("query_id is not null")
    plan = plan_selection(state, states.filter("passed"), states.filter("failed"), config["min_observations"], config["allow_unvalidated"])
    plan = materialize(plan.withColumn("decision", F.coalesce("reason", F.lit("selected"))), "plan")
    plan.write.mode("overwrite").partitionBy("decision").parquet(f"{out}/plan")
    counts = {r["decision"]: r["n"] for r in plan.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a decision
    log.info("read %s, wrote the plan %s to %s/plan", validation, counts, out)
    return {"rows": taken, "upto": mark if upto is None else upto, "decisions": counts}


def read_output(spark: SparkSession, out: str) -> DataFrame:
    """The plan as it stands."""
    return spark.read.schema(SCHEMA).option("basePath", f"{out}/plan").parquet(f"{out}/plan")


if __name__ == "__main__":
    sys.exit(command_line(__doc__, {"ledger": "the ledger of observations", "validation": "states of validation by query", "out": "folder of statistics, marks and the plan"}, run, NAME))
