"""Ledger statistics and the planners on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked


STATE = "query_id long, observations long, selected long, supported long, first_place long, last_place long, total_ms long, later_ms long, max_ms long"


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """By query: observations, selected and supported counts, first and last place, times.

    ledger: query_id, place (a total order), selected, supported, ms. later_ms adds each row from a query's second
    supported one on, itself included.
    """
    # Known to be empty when the query is planned, so nothing is joined with it.
    none = ledger.sparkSession.range(1).filter(F.lit(False)).selectExpr(*[f"cast(null as {kind}) as {name}" for name, kind in (c.split() for c in STATE.split(", "))])
    return merge_stats(none, ledger)


def merge_stats(state: DataFrame, ledger: DataFrame) -> DataFrame:
    """The statistics (as ``ledger_stats`` has them) of the rows that ``state`` counts and those of ``ledger``, all of
    which come after them. They are those of all rows taken together.

    Where later time begins are the two first supported places of a query, two plain minima: no query's rows are sorted
    or gathered, however many one has. Beside the ledger, only tables with a row a query are joined.
    """
    good = ledger.filter("supported").select("query_id", "place")
    first = good.groupBy("query_id").agg(F.min("place").alias("one"))
    second = good.join(first, "query_id").filter(F.col("place") > F.col("one")).groupBy("query_id").agg(F.min("place").alias("two"))
    had = state.select("query_id", F.col("supported").alias("had"))
    begin = first.join(second, "query_id", "left").join(had, "query_id", "full").select("query_id", F.when(F.col("had") >= 2, F.lit(-(1 << 63)).cast("long")).when(F.col("had") == 1, F.col("one")).otherwise(F.col("two")).alias("begin"))
    new = ledger.join(begin, "query_id", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("observations"),
        F.sum(F.col("selected").cast("int")).alias("selected"),
        F.sum(F.col("supported").cast("int")).alias("supported"),
        F.min("place").alias("first_place"),
        F.max("place").alias("last_place"),
        F.sum("ms").alias("total_ms"),
        F.coalesce(F.sum(F.when(F.col("place") >= F.col("begin"), F.col("ms"))), F.lit(0)).alias("later_ms"),
        F.max("ms").alias("max_ms"),
    )
    of = {"first_place": F.min, "last_place": F.max, "max_ms": F.max}
    return state.unionByName(new).groupBy("query_id").agg(*[of.get(c, F.sum)(c).alias(c) for c in new.columns[1:]])


def plan_selection(stats: DataFrame, passed: DataFrame, failed: DataFrame, min_observations: int = 2, allow_unvalidated: bool = False) -> DataFrame:
    """Stats with the reason against selection (null: none), ranked: good ones first, most later time first."""
    rows = stats.join(passed.select("query_id", F.lit(True).alias("passed")).distinct(), "query_id", "left").join(failed.select("query_id", F.lit(True).alias("failed")).distinct(), "query_id", "left")
    reason = F.when(F.col("failed"), "validation_failed").when(F.col("passed").isNull() & F.lit(not allow_unvalidated), "missing_validation").when(F.col("supported") < min_observations, "insufficient_supported_observations")
    order = [F.col("reason").isNotNull(), F.desc("later_ms"), F.desc("supported"), F.col("first_place"), F.abs("query_id"), F.col("query_id")]
    return ranked(rows.withColumn("reason", reason).drop("passed", "failed"), order, "rank")


def accounting(rows: DataFrame, query: str, edge: str) -> DataFrame:
    """Row counts by query, by edge and by both, in one pass of grouping sets; each level sums to all rows."""
    q, e = F.col(query), F.col(edge)
    return rows.groupingSets([[q], [e], [q, e]], q, e).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


def longest_by_window(rows: DataFrame, width: int) -> DataFrame:
    """Of the rows (id, begin, length, value) in each stretch of ``width``, the longest; the first of equal ones."""
    best = F.max_by(F.struct("begin", "length", "value"), F.struct(F.col("length"), -F.col("begin"), -F.col("value")))
    return rows.groupBy("id", F.floor(F.col("begin") / width).alias("stretch")).agg(best.alias("best")).select("id", "stretch", "best.begin", "best.length", "best.value")
