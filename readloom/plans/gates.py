"""Gates between a computed result and the one it is to replace: reasons, ownership, live edges, field differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_reasons(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``rows`` with reasons: the names of all rules (SQL conditions) that hold, in the order given; null holds not."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()])))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def ownership(rows: DataFrame, replacement: DataFrame, selected: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Every row with its decision: replaced, selected_missing (its unit was chosen, no replacement came), or kept."""
    there = replacement.select(*keys, F.lit(True).alias("there")).distinct()
    chosen = selected.select(unit, F.lit(True).alias("chosen")).distinct()
    met = rows.join(chosen, unit, "left").join(there, keys, "left")
    decision = F.when(F.col("chosen").isNull(), "kept").when(F.col("there"), "replaced").otherwise("selected_missing")
    return met.withColumn("decision", decision).drop("there", "chosen")


def edge_state(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows with state of their edge_id: none (null or 0), live, or unresolved."""
    met = rows.join(live.select("edge_id", F.lit(True).alias("is_live")).distinct(), "edge_id", "left")
    state = F.when(F.coalesce("edge_id", F.lit(0)) == 0, "none").when(F.col("is_live"), "live").otherwise("unresolved")
    return met.withColumn("state", state).drop("is_live")


def field_differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], tolerance: float = 0.0) -> DataFrame:
    """(field, n): how many rows of equal keys differ in a field by more than ``tolerance``, nulls equal; 0 rows too."""
    a, b = (x.select(*keys, *[F.col(f).alias(f"{f}_{s}") for f in fields]) for x, s in ((left, "a"), (right, "b")))
    differ = lambda f: ~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")) & (F.coalesce(F.abs(F.col(f"{f}_a") - F.col(f"{f}_b")) > tolerance, F.lit(True)))
    counts = a.join(b, keys).agg(*[F.count_if(differ(f)).alias(f) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("x")).select("x.*")


def crossover(runs: DataFrame) -> DataFrame:
    """(mode, first_size): the smallest size whose mean control time is above its mean time, null if none.

    runs: mode, size, control_ms, ms.
    """
    means = runs.groupBy("mode", "size").agg(F.avg("control_ms").alias("control"), F.avg("ms").alias("own"))
    return means.groupBy("mode").agg(F.min(F.when(F.col("control") > F.col("own"), F.col("size"))).alias("first_size"))
