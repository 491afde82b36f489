"""Comparisons of result sets as multisets of records; no record is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical_diff(left: DataFrame, right: DataFrame, width: int | None = None) -> DataFrame:
    """One row: status, records on both sides, and how many of either have no counterpart. One shuffle for each side, to
    ``width`` partitions if it is stated."""
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*columns, F.lit(0).alias("l"), F.lit(1).alias("r")))
    both = both if width is None else both.repartition(width, *columns)
    g = both.groupBy(*columns).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = g.agg(total("l").alias("left_records"), total("r").alias("right_records"), total(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("missing"), total(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("extra"))
    return out.withColumn("status", F.when((F.col("missing") == 0) & (F.col("extra") == 0), "match").otherwise("mismatch"))


def row_key_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(state, n): keys that are matched, missing at the right, or extra there."""
    a, b = left.select(*keys).distinct().withColumn("a", F.lit(1)), right.select(*keys).distinct().withColumn("b", F.lit(1))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("matched")
    return a.join(b, keys, "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def assert_equal(left: DataFrame, right: DataFrame) -> None:
    """The gate: an error unless both are one multiset."""
    r = canonical_diff(left, right).first()
    if r["status"] != "match":
        raise ValueError(f"record sets differ: {r.asDict()}")
