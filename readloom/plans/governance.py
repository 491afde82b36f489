"""Gates that fail closed, the steps between them, and what a replay is allowed to take."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.candidates import unless_large
from ..operators.chains import chain_inputs
from ..operators.grouping import width_for
from ..operators.ranking import ranked
from ..sources.scratch import materialize
from .checks import attach, digest
from .diffs import canonical_diff
from .gates import ownership, with_reasons

# The shapes that a packed replay takes, as conditions on what it does not take.
SHAPE_REASONS = {
    "base_alignment": "nucl_alignment",
    "trimming": "partition_bad_mappings",
    "kept_alignment": "keep_alignment",
    "several_overlaps_a_target": "not only_max_ext",
    "limited_overlaps": "max_overlaps != 0",
}
# Most hits of a group, and most overlaps of a fixture.
GROUP_HITS, FIXTURE_OVERLAPS = 4096, 2048
# What must hold before a result is used in place of the one it was checked against.
GUARD_CHECKS = ("explicit_guard_mode", "validation_passed", "shadow_mode_selected", "shadow_passed", "fixture_count_matches_request", "audit_metadata_available")


def supported_shapes(fixtures: DataFrame) -> DataFrame:
    """Fixtures (parameters as columns) with the reasons why a packed replay does not take them."""
    return with_reasons(fixtures, SHAPE_REASONS)


def capacity_faults(groups: DataFrame, column: str, most: int) -> DataFrame:
    """Groups above a stated capacity; nothing here needs one, so this is a check of packs made for others."""
    return groups.filter(F.col(column) > most)


def checks_of(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, passed): each named condition, an aggregate over ``rows``; null has not passed."""
    one = rows.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n in checks])).alias("c")).select("c.*")


def require_checks(checks: DataFrame) -> None:
    """An error that names every check that has not passed."""
    if bad := sorted(r["check"] for r in checks.filter("not passed").collect()):  # one row a named check
        raise ValueError(f"checks failed: {', '.join(bad)}")


def guard(checks: DataFrame) -> DataFrame:
    """(check, passed) of every precondition of a consumption guard; one that is not stated has not passed."""
    needed = checks.sparkSession.createDataFrame([(n,) for n in GUARD_CHECKS], "check string")
    return F.broadcast(needed).join(checks.select("check", "passed"), "check", "left").select("check", F.coalesce("passed", F.lit(False)).alias("passed"))


def rehydrated(rows: DataFrame) -> DataFrame:
    """``rows`` written as text fields and cast back to their types, as a reader of a record file would have them."""
    return rows.select(*[F.col(f.name).cast("string").cast(f.dataType).alias(f.name) for f in rows.schema])


def as_objects(rows: DataFrame, key: str) -> DataFrame:
    """(key, objects): the rows of a key as an array of structs, in the order of their fields."""
    fields = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("objects"))


def from_objects(objects: DataFrame, key: str) -> DataFrame:
    return objects.select(key, F.explode("objects").alias("o")).select(key, "o.*")


def verified_substitution(rows: DataFrame, replacement: DataFrame, selected: DataFrame, unit: str) -> DataFrame:
    """``rows`` with those of selected units taken from ``replacement``; an error unless both slices are one bag."""
    # Rows move by unit to as many partitions as they need, so that no task's memory grows with them.
    width = width_for(rows.count() + replacement.count(), rows.sparkSession)
    chosen = selected.select(unit).distinct().repartition(width, unit)
    of = lambda df: df.repartition(width, unit).join(chosen, unit, "left_semi").select(*rows.columns)
    r = canonical_diff(of(rows), of(replacement), width).first()
    if r["status"] != "match":
        raise ValueError(f"the replacement differs: {r.asDict()}")
    return rows.repartition(width, unit).join(chosen, unit, "left_anti").unionByName(of(replacement))


def consumption_parity(decisions: DataFrame, stated: DataFrame) -> DataFrame:
    """(decision, stated, found, same): the counts of merged rows against those a dry run stated (decision, n)."""
    found = decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("found"))
    met = stated.select("decision", F.col("n").alias("stated")).join(found, "decision", "full").fillna(0, ["stated", "found"])
    return met.withColumn("same", F.col("stated") == F.col("found"))


def mutation_canary(raw: DataFrame, rebuild, accepted: DataFrame) -> DataFrame:
    """The difference of the chains that ``rebuild`` makes of the raw rows and those that were accepted."""
    return canonical_diff(rebuild(chain_inputs(raw)).select(*accepted.columns), accepted)


def fill_placeholders(placeholders: DataFrame, rebuilt: DataFrame, key: str, value: str) -> DataFrame:
    """Placeholders with the value rebuilt for them; one that nothing was rebuilt for ends the job when it is read."""
    return attach(placeholders.drop(value), rebuilt.select(key, value), [key], value)


def audit_sample(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The rows of listed keys; all rows if the list is empty."""
    return rows if listed.isEmpty() else rows.join(listed.select(key).distinct(), key, "left_semi")


def without_first(rows: DataFrame, order: list[str]) -> DataFrame:
    """Fault injection: ``rows`` less the first in a total order. Gates after it must fail."""
    first = rows.agg(F.min(F.struct(*order)).alias("first"))
    return rows.join(F.broadcast(first), F.struct(*order) == F.col("first"), "left_anti")


def expectations(rows: DataFrame, records: int | None = None, expected_digest: str | None = None) -> DataFrame:
    """(check, passed) for the number of rows and their bag's digest, as far as they are stated."""
    got = digest(rows)
    stated = {"records": (F.col("records"), records), "digest": (F.col("digest"), expected_digest)}
    return checks_of(got, {n: F.bool_and(c == F.lit(v)) for n, (c, v) in stated.items() if v is not None})


def pack_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status) of two packs' digests (key, digest): match, mismatch, missing_left or missing_right."""
    met = left.select(key, F.col("digest").alias("a")).join(right.select(key, F.col("digest").alias("b")), key, "full")
    return met.select(key, F.when(F.col("a").isNull(), "missing_left").when(F.col("b").isNull(), "missing_right").when(F.col("a") == F.col("b"), "match").otherwise("mismatch").alias("status"))


def packed(fixtures: DataFrame, params: DataFrame) -> DataFrame:
    """Rows of all fixtures in one table, each with the index of its parameters (params: fixture and values, numbered by
    them, nulls first and equal to each other)."""
    values = [c for c in params.columns if c != "fixture"]
    numbered = ranked(params.select(*values).distinct(), values, "param_index", 0).select(*[F.col(v).alias(f"own_{v}") for v in values], "param_index")
    same = reduce(lambda x, y: x & y, (F.col(v).eqNullSafe(F.col(f"own_{v}")) for v in values))
    return fixtures.join(params, "fixture").join(unless_large(numbered), same).drop(*values, *[f"own_{v}" for v in values])


def shadow_checks(summary: DataFrame) -> DataFrame:
    """The counts of a shadow ledger tie out: raw rows are chain inputs and filtered ones, and lie in one state of edge."""
    total = lambda *c: sum((F.sum(x) for x in c[1:]), F.sum(c[0]))
    return checks_of(summary, {
        "chain_inputs_and_filtered": total("chain_inputs", "filtered") == total("raw"),
        "states_of_edges": total("edge_zero", "edge_live", "edge_unresolved") == total("raw"),
        "all_edges_resolve": F.sum("edge_unresolved") == 0,
    })


def accounting_checks(levels: DataFrame, rows: DataFrame) -> DataFrame:
    """Each level of ``accounting`` sums to the number of rows: (level, total, passed)."""
    n = rows.agg(F.count(F.lit(1)).alias("rows"))
    return levels.groupBy("level").agg(F.sum("n").alias("total")).join(F.broadcast(n)).select("level", "total", (F.col("total") == F.col("rows")).alias("passed"))  # n is one row


def bypass(rows: DataFrame, replacement: DataFrame, selected: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """One row: total, eligible and residual rows of a bypass plan, and do both make up the total."""
    d = ownership(rows, replacement, selected, keys, unit)
    out = d.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision") == "replaced").alias("eligible"), F.count_if(F.col("decision") != "replaced").alias("residual"))
    return out.withColumn("ties_out", F.col("eligible") + F.col("residual") == F.col("total"))


def boundary_replay(raw: DataFrame, oracle: DataFrame, **limits) -> DataFrame:
    """The difference of the chain inputs made of raw overlaps and the recorded ones."""
    return canonical_diff(chain_inputs(raw, **limits).select(*oracle.columns), oracle)


def budgeted(rows: DataFrame, key: str, size: str, most: int, budget: int) -> DataFrame:
    """(key): keys (unique) in order while fewer than ``most`` and within ``budget``; what does not fit is passed over.

    Keys are dealt out by ranges. A round takes keys, of those that still fit by themselves, up to the first one that does
    not fit with those before it: the sum of each range says in which range that is, and a running sum over that range alone
    says where. What is too large for the rest then is dropped, and the next round begins behind that key. Every round takes
    a key, so there are at most ``most``; the result is the keys between their ends.
    """
    spark = rows.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pairs = rows.select(F.col(key).cast("long").alias(key), F.col(size).cast("long").alias("size")).filter(f"`{key}` is not null and size is not null")
    laid = materialize(pairs.repartitionByRange(width, key).withColumn("part", F.spark_partition_id()), "key-ranges")
    left, room, after, taken = most, budget, None, F.lit(False)
    while left > 0:
        fit = laid.filter(F.col("size") <= room) if after is None else laid.filter((F.col("size") <= room) & (F.col(key) > after))
        n = total = 0
        full = None
        for r in sorted(fit.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).collect()):  # bounded: one a partition
            if n + r["n"] > left or total + r["total"] > room:
                full = r["part"]
                break
            n, total = n + r["n"], total + r["total"]
        inside = (F.col("size") <= room) & (F.lit(True) if after is None else F.col(key) > after)
        if full is None:
            taken |= inside
            break
        so_far = Window.partitionBy("part").orderBy(key)
        line = fit.filter(F.col("part") == full).withColumns({"n": F.row_number().over(so_far) + n, "total": F.sum("size").over(so_far) + total})
        stop = line.filter((F.col("n") > left) | (F.col("total") > room)).orderBy(key).first()
        taken |= inside & (F.col(key) < stop[key])
        left, room, after = left - (stop["n"] - 1), room - (stop["total"] - stop["size"]), stop[key]
    return laid.filter(taken).select(key)


def timing_totals(rows: DataFrame, columns: list[str], chosen: Column) -> DataFrame:
    """One row: the sum of every timing column over all rows and over the chosen ones."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return rows.agg(*[total(F.col(c), f"all_{c}") for c in columns], *[total(F.when(chosen, F.col(c)), f"chosen_{c}") for c in columns])


def decisions_of(ledger: DataFrame) -> DataFrame:
    """(query_id, unsupported, decisions): the rows that were not supported, and the set of decisions."""
    return ledger.groupBy("query_id").agg(F.count_if(~F.col("supported")).alias("unsupported"), F.array_join(F.array_sort(F.collect_set("decision")), ",").alias("decisions"))


def ids_by_shape(fixtures: DataFrame, shape: list[str], key: str) -> DataFrame:
    """(shape, n, ids): the keys of each shape in order, joined by commas."""
    ids = F.transform(F.sort_array(F.collect_list(key)), lambda x: x.cast("string"))
    return fixtures.groupBy(*shape).agg(F.count(F.lit(1)).alias("n"), F.array_join(ids, ",").alias("ids"))


def fixtures_in_order(fixtures: DataFrame) -> DataFrame:
    """Fixtures with place: most candidate records first, then by query."""
    return ranked(fixtures, [F.desc("candidate_records"), "query_id"], "place", 0)


def ordered_matches(left: DataFrame, right: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """One row: rows of both sides, and how many have the same key at the same place."""
    a, b = (x.select(F.col(order).alias("place"), F.struct(*keys).alias(s)) for x, s in ((left, "a"), (right, "b")))
    met = a.join(b, "place", "full")
    return met.agg(F.count("a").alias("left_rows"), F.count("b").alias("right_rows"), F.count_if(F.col("a") == F.col("b")).alias("same_place"))


def unproved(states: DataFrame) -> DataFrame:
    """(query_id, unproved): by a query's source and result (source, status, geometry), what a replay of it left open."""
    reason = F.when(F.col("status") == "match", "fields_beside_the_key").when(F.col("geometry") == "match", "score_and_divergence").when(F.col("source") == "full-query-hits", "order_of_equal_hits").otherwise("hits_beside_minimizers")
    return states.select("query_id", reason.alias("unproved"))
