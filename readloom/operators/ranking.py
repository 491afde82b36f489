"""Ranks over a whole table without an ordered partition that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: monotonically_increasing_id has the partition above so many bits, and the place in it below.
_PLACE_BITS = 33


def ranked(df: DataFrame, order: list[Column | str], name: str, start: int = 1) -> DataFrame:
    """``df`` with the rank of every row in ``order``, which should be total: equal rows are ranked in any order.

    Rows are dealt out by ranges of the order and sorted where they lie; what a partition's ranks begin with is the number
    of rows in those before it. Only these numbers, one a partition, meet in one place. The ranges are written once, as
    they are drawn from a sample.
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    laid = df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    laid = materialize(laid, "ranges")
    part, place = F.shiftright(F.col(name), _PLACE_BITS), F.col(name).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    sizes = {r["part"]: r["n"] for r in laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded: one a partition
    before, seen = [], start
    for i in range(width):
        before.append(seen)
        seen += sizes.get(i, 0)
    return laid.withColumn(name, F.get(F.array(*[F.lit(b).cast("long") for b in before]), part.cast("int")) + place)
