"""Order checks, positions within groups, digests, and counts of places within ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_checks(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """By group: n, whether ``order`` is exactly 0..n-1, and whether ``value`` never falls along it (equal places by value)."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order, value))
    g = rows.select(group, order, (F.col(value) < before).alias("falls")).groupBy(group)
    whole = (F.min(order) == 0) & (F.max(order) == F.count(F.lit(1)) - 1) & (F.count_distinct(order) == F.count(F.lit(1)))
    return g.agg(F.count(F.lit(1)).alias("n"), whole.alias("contiguous"), (~F.coalesce(F.bool_or("falls"), F.lit(False))).alias("sorted"))


def broken_groups(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(group, key, stretches): keys that come back after another key came between."""
    before = F.lag(key).over(Window.partitionBy(group).orderBy(order))
    starts = rows.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col(key)))
    return starts.groupBy(group, key).agg(F.count(F.lit(1)).alias("stretches")).filter("stretches > 1")


def with_offsets(rows: DataFrame, group: str, order: list[str], size: Column) -> DataFrame:
    """Rows with source_order (0-based) and offset, the sizes of all rows of the group before; ``order`` must be total."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumns({"source_order": F.row_number().over(w) - 1, "offset": F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})


def middle_rows(rows: DataFrame, group: str, metric: str, *ties: str) -> DataFrame:
    """The row at place n div 2 of every group, by metric and then ``ties``."""
    every = Window.partitionBy(group)
    placed = rows.withColumns({"place": F.row_number().over(every.orderBy(metric, *ties)), "of": F.count(F.lit(1)).over(every)})
    return placed.filter(F.col("place") == F.floor(F.col("of") / 2) + 1).drop("place", "of")


def scaled(rows: DataFrame, group: str, metric: str) -> DataFrame:
    """Rows with ``scaled``: the metric from 0 at the group's least to 1 at its largest, 0 where all are equal."""
    g = Window.partitionBy(group)
    low, high = F.min(metric).over(g), F.max(metric).over(g)
    return rows.withColumn("scaled", F.when(high == low, 0.0).otherwise((F.col(metric) - low) / (high - low)))


def digest(rows: DataFrame) -> DataFrame:
    """(records, digest): equal for equal bags of rows in any order; no sort and no row in one place. A check sum of this
    engine's own; what is to be compared with recorded hashes of canonical files is in ``digests``.

    The digest adds 60 bits of the MD5 of every row's fields, joined by tabs, nulls as a backslash and N.
    """
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in rows.columns])
    part = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def as_set(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, copies): the set of a bag's keys, with how often each was in it; nulls are equal to each other."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def excess(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows of the bag ``part`` that ``whole`` has not, or not as often; empty when it is a part of it."""
    return part.exceptAll(whole.select(*part.columns))


def places_in_ranges(ranges: DataFrame, places: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Ranges (key, begin, end inclusive, others) with ``inside``, the number of places (key, position) within.

    Both sides meet by key and stretch of ``width``, so a key with many places does not meet its ranges all at once.
    """
    numbered = ranges.withColumn("range_no", F.monotonically_increasing_id())
    cut = lambda c: F.floor(F.col(c) / width)
    spread = numbered.filter(F.col("begin") <= F.col("end")).select("range_no", key, "begin", "end", F.explode(F.sequence(cut("begin"), cut("end"))).alias("stretch"))
    counted = places.groupBy(key, "position").agg(F.count(F.lit(1)).alias("copies")).withColumn("stretch", cut("position"))
    met = spread.join(counted, [key, "stretch"]).filter(F.col("position").between(F.col("begin"), F.col("end")))
    found = met.groupBy("range_no").agg(F.sum("copies").alias("inside"))
    return numbered.join(found, "range_no", "left").drop("range_no").fillna(0, ["inside"])


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], needed: str) -> DataFrame:
    """``rows`` with the facts of equal keys; a row without its fact ends the job when it is read."""
    met = rows.join(facts, keys, "left")
    text = F.concat(F.lit("no fact for "), F.to_json(F.struct(*keys)))
    return met.withColumn(needed, F.when(F.col(needed).isNull(), F.raise_error(text)).otherwise(F.col(needed)))


def identity_states(packed: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, state) of packed reads: same, differs, or absent from ``reads``."""
    met = packed.select("read_id", F.col("seq").alias("a")).join(reads.select("read_id", F.col("seq").alias("b")), "read_id", "left")
    return met.select("read_id", F.when(F.col("b").isNull(), "absent").when(F.col("a") == F.col("b"), "same").otherwise("differs").alias("state"))
