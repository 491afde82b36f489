"""Summaries of what a plan would gain, with named checks that must all pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import safe_ratio

#: The times of a run that left its own chaining out: filling in what was rebuilt, and the request that made it.
FILL = ("placeholder", "rebuild", "compare", "substitution")


def as_checks(row: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, passed) rows of one row; a check that is null has not passed."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])).alias("c")).select("c.*")


def target_checks(chosen: DataFrame, cost: str, boundary_cost: float, least_ratio: float, hot_cost: float | None) -> DataFrame:
    """(check, passed) of a target plan (raw, chain_inputs and ``cost`` of the queries it takes).

    It must have queries, raw overlaps and chain inputs; its cost must be at least ``least_ratio`` times that of the boundary
    before it; and what a warm request took must be less than its cost.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    row = chosen.agg(F.count(F.lit(1)).alias("queries"), total("raw").alias("raw"), total("chain_inputs").alias("inputs"), total(cost).alias("cost"))
    return as_checks(row, {
        "selected_query_count_positive": F.col("queries") > 0,
        "selected_has_raw_overlaps": F.col("raw") > 0,
        "selected_has_chain_inputs": F.col("inputs") > 0,
        "selected_cost_exceeds_boundary": safe_ratio(F.col("cost"), F.lit(boundary_cost)) >= least_ratio,
        "hot_request_below_selected_cost": F.lit(hot_cost) < F.col("cost"),
    })


def skip_timing(selected: DataFrame, control: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: what selected queries cost by themselves, and what they cost when their own chaining is left out.

    selected: query_id; control: query_id, chain and divergence; skipped: query_id, the times of ``FILL``, request and
    kernel. control_ms is chain and divergence; fill_ms the times of FILL; cold_ms adds the whole request, hot_ms the kernel
    alone. Ratios are to control_ms, null where that is 0. missing counts selected queries without a control; skipped, the
    distinct ones that were left out.
    """
    chosen = selected.select("query_id").distinct()
    total = lambda *names: F.coalesce(sum((F.sum(n) for n in names[1:]), F.sum(names[0])), F.lit(0))
    own = chosen.join(control.groupBy("query_id").agg(total("chain", "divergence").alias("ms")), "query_id", "left")
    own = own.agg(F.count(F.lit(1)).alias("selected"), F.count_if(F.col("ms").isNull()).alias("missing"), total("ms").alias("control_ms"))
    way = skipped.join(chosen, "query_id", "left_semi").agg(F.count_distinct("query_id").alias("skipped"), total(*FILL).alias("fill_ms"), total("request").alias("request_ms"), total("kernel").alias("kernel_ms"))
    row = own.join(way)  # one row each
    row = row.withColumns({"cold_ms": F.col("request_ms") + F.col("fill_ms"), "hot_ms": F.col("kernel_ms") + F.col("fill_ms")})
    return row.withColumns({f"{w}_ratio": safe_ratio(F.col(f"{w}_ms"), F.col("control_ms")) for w in ("cold", "hot")} | {f"{w}_faster": F.col(f"{w}_ms") < F.col("control_ms") for w in ("cold", "hot")})


def skip_checks(timing: DataFrame) -> DataFrame:
    """(check, passed) of a skip_timing row."""
    return as_checks(timing, {"control_has_all_selected_queries": F.col("missing") == 0, "selected_query_counts_match": F.col("skipped") == F.col("selected"), "fill_timing_recorded": F.col("fill_ms") > 0})
