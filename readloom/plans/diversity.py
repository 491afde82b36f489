"""Selection of a few rows that differ most, over a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..sources.scratch import materialize


def diverse(rows: DataFrame, metrics: list[str], most: int, ties: list[str], key: str) -> DataFrame:
    """(place, key, reason) of at most ``most`` rows: least, largest and middle one of each metric, then the farthest ones.

    rows: key (unique), query_id, the metrics and ``ties``, none null. Distance is squared over metrics scaled to 0..1, from
    the nearest row taken so far; of equal ones the larger ``ties`` decide, then the smaller absolute query_id, then the
    larger query_id. Each row taken is one pass over the table, which keeps its distances as an expression over the rows
    taken before, ``most`` at the most; only these are known to the driver.
    """
    spark, schema = rows.sparkSession, f"place int, {key} {dict(rows.dtypes)[key]}, reason string"
    rows = materialize(rows.select(*dict.fromkeys([key, "query_id", *metrics, *ties])), "eligible")
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(m).alias(f"{w}_{m}") for m in metrics for w, f in (("low", F.min), ("high", F.max))]).first()
    if not ends["n"] or most < 1:
        return spark.createDataFrame([], schema)
    scaled = [(F.col(m) - F.lit(ends[f"low_{m}"])) / F.lit(float(ends[f"high_{m}"] - ends[f"low_{m}"] or 1)) for m in metrics]
    rows = rows.withColumn("at", F.array(*scaled))
    chosen: dict = {}
    for m in metrics:
        order = F.struct(m, "query_id", key)
        first, last = rows.agg(F.min_by(F.struct(key, "at"), order), F.max_by(F.struct(key, "at"), order)).first()
        middle = ranked(rows.select(key, "query_id", m, "at"), [m, "query_id", key], "nth", 0).filter(F.col("nth") == ends["n"] // 2).first()
        for name, r in (("min", first), ("max", last), ("median", middle)):
            if len(chosen) < most and r[key] not in chosen:
                chosen[r[key]] = (r["at"], f"{m}_{name}")
    n = 0
    while len(chosen) < min(most, ends["n"]):
        n += 1
        near = [sum(((F.col("at")[i] - F.lit(x)) * (F.col("at")[i] - F.lit(x)) for i, x in enumerate(at[1:], 1)), (F.col("at")[0] - F.lit(at[0])) * (F.col("at")[0] - F.lit(at[0]))) for at, _ in chosen.values()]
        apart = F.least(*near) if len(near) > 1 else near[0]
        best = rows.filter(~F.col(key).isin(list(chosen))).agg(F.max_by(F.struct(key, "at"), F.struct(apart.alias("apart"), *ties, (-F.abs("query_id")).alias("q"), "query_id")).alias("r")).first()["r"]
        chosen[best[key]] = (best["at"], f"greedy_shape_diversity_{n:02d}")
    return spark.createDataFrame([(i, k, reason) for i, (k, (_, reason)) in enumerate(chosen.items())], schema)
