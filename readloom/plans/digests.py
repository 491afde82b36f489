"""SHA-256 of canonical text: equal to a recorded hash of the same records, whatever order or partitions they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dumps import nine_digits


def record_line(rows: DataFrame, fields: list[str]) -> Column:
    """The fields of a row as its line in a canonical file: tabs between, floats with nine digits, nulls as backslash N."""
    real = {f.name for f in rows.schema if f.dataType.typeName() in ("float", "double")}
    text = lambda c: nine_digits(F.col(c).cast("double")) if c in real else F.col(c).cast("string")
    return F.concat_ws("\t", *[F.coalesce(text(c), F.lit("\\N")) for c in fields])


def unit_digests(rows: DataFrame, unit: str, fields: list[str]) -> DataFrame:
    """(unit, records, sha256): the hash of each unit's canonical text, its rows as lines in the order of their fields.

    A unit is what is recorded together, as a query or a fixture; its rows must fit in memory.
    """
    lined = rows.select(unit, F.struct(*fields).alias("at"), record_line(rows, fields).alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return lined.groupBy(unit).agg(F.count(F.lit(1)).alias("records"), F.sha2(F.concat(text, F.lit("\n")), 256).alias("sha256"))


def whole_digest(digests: DataFrame, unit: str) -> DataFrame:
    """One row: units, records and one hash of all of (unit, records, sha256), in order of the units within 65,536 buckets.

    A bucket is the first four digits of the hash of a unit's name; its lines, and then those of the buckets, are hashed in
    order. So no step takes more than a bucket's units, or one line a bucket.
    """
    joined = lambda *fields: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*fields))), lambda x: F.concat_ws("\t", *[x[f].cast("string") for f in fields])), "\n")
    bucket = F.substring(F.sha2(F.coalesce(F.col(unit).cast("string"), F.lit("\\N")), 256), 1, 4)
    each = digests.withColumn("bucket", bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("units"), F.sum("records").alias("records"), F.sha2(joined(unit, "sha256"), 256).alias("part"))
    return each.agg(F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.sha2(joined("bucket", "part"), 256).alias("sha256"))
