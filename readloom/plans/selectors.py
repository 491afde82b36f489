"""Which queries, fixtures and samples a run takes, and what it may expect of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.candidates import lookup_windows
from .gates import edge_state, with_reasons

# Names of the reasons against a query, with their conditions.
PACK_REASONS = {
    "raw_overlap_count_zero": "raw = 0",
    "chain_input_count_zero": "chain_inputs = 0",
    "raw_overlap_count_exceeds_limit": "raw > {most_raw}",
    "chain_input_count_exceeds_limit": "chain_inputs > {most_chain}",
    "duplicate_chain_input_read_begin": "begins < chain_inputs",
}
SAFE_LABEL = "^[A-Za-z0-9][A-Za-z0-9_.-]*$"


def query_summary(rows: DataFrame, live: DataFrame) -> DataFrame:
    """By query: raw rows, chain inputs, their distinct begins, filtered rows, and rows by state of their edge.

    rows: query_id, edge_id, read_begin, passes.
    """
    count = lambda c: F.count_if(c)
    return edge_state(rows, live).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("raw"),
        count(F.col("passes")).alias("chain_inputs"),
        F.count_distinct(F.when(F.col("passes"), F.col("read_begin"))).alias("begins"),
        count(~F.col("passes")).alias("filtered"),
        count(F.col("state") == "none").alias("edge_zero"),
        count(F.col("state") == "live").alias("edge_live"),
        count(F.col("state") == "unresolved").alias("edge_unresolved"),
    )


def pack_support(summary: DataFrame, most_raw: int, most_chain: int) -> DataFrame:
    return with_reasons(summary, {k: v.format(most_raw=most_raw, most_chain=most_chain) for k, v in PACK_REASONS.items()})


def plan_targets(supported: DataFrame, cost: str, most: int) -> DataFrame:
    """Of the queries without a reason, the ``most`` with the highest cost, ties to the smaller id."""
    return supported.filter(F.size("reasons") == 0).orderBy(F.desc(cost), "query_id").limit(most)


def target_gain(every: DataFrame, chosen: DataFrame, cost: str) -> DataFrame:
    """One row: queries and cost overall and chosen, and the chosen share of the cost (null: no cost)."""
    total = lambda df, p: df.agg(F.count(F.lit(1)).alias(f"{p}_queries"), F.coalesce(F.sum(cost), F.lit(0)).alias(f"{p}_cost"))
    both = total(every, "all").join(total(chosen, "chosen"))  # one row each
    return both.withColumn("share", F.when(F.col("all_cost") != 0, F.col("chosen_cost") / F.col("all_cost")))


def plan_pack(supported: DataFrame, most: int) -> DataFrame:
    """``most`` queries: the first with filtered rows, the first other one with several raw rows, then by id.

    Every candidate for a place is one of the ``most`` + 2 first rows of a kind, so three short lists decide.
    """
    fit = supported.filter(F.size("reasons") == 0)
    first = fit.filter("filtered > 0").orderBy("query_id").limit(1).withColumn("turn", F.lit(0))
    second = fit.filter("raw > 1").join(first.select("query_id"), "query_id", "left_anti").orderBy("query_id").limit(1).withColumn("turn", F.lit(1))
    rest = fit.orderBy("query_id").limit(most + 2).withColumn("turn", F.lit(2))
    lists = first.unionByName(second).unionByName(rest)
    least = lists.groupBy("query_id").agg(F.min("turn").alias("turn"))
    return fit.join(F.broadcast(least.orderBy("turn", "query_id").limit(most)), "query_id").drop("reasons")


def shape_batches(fixtures: DataFrame, shape: list[str], most_rows: int) -> DataFrame:
    """Fixtures (fixture, rows, shape) of at most ``most_rows`` rows, grouped by shape: how many, rows, first and last."""
    return fixtures.filter(F.col("rows") <= most_rows).groupBy(*shape).agg(F.count(F.lit(1)).alias("fixtures"), F.sum("rows").alias("total_rows"), F.min("fixture").alias("first"), F.max("fixture").alias("last"))


def parse_samples(specs: DataFrame) -> DataFrame:
    """(label, offset, length) of texts LABEL:OFFSET:LENGTH; length null stands for full. A bad text ends the job."""
    p = F.split("spec", ":", -1)
    good = (F.size(p) == 3) & p[0].rlike(SAFE_LABEL) & p[1].rlike(r"^\d+$") & p[2].rlike(r"^(full|0*[1-9]\d*)$")
    checked = specs.withColumn("spec", F.when(good, F.col("spec")).otherwise(F.raise_error(F.concat(F.lit("bad sample "), F.col("spec")))))
    return checked.select(p[0].alias("label"), p[1].cast("int").alias("offset"), F.when(p[2] != "full", p[2]).cast("int").alias("length"))


def cut_samples(sources: DataFrame, samples: list[str], k: int) -> DataFrame:
    """(sample, source_id, seq): each stated sample of every source (source_id, seq); those that do not fit are left out."""
    spark: SparkSession = sources.sparkSession
    specs = parse_samples(spark.createDataFrame([(s,) for s in samples], "spec string")).collect()
    stated = F.array(*[F.struct(F.lit(s["label"]).alias("label"), F.lit(s["offset"]).alias("offset"), F.lit(s["length"]).cast("int").alias("length")) for s in specs])
    rows = sources.select("source_id", "seq", F.explode(stated).alias("s"))
    rows = rows.select("source_id", "seq", "s.label", "s.offset", F.coalesce("s.length", F.length("seq") - F.col("s.offset")).alias("length"))
    fit = rows.filter((F.col("length") >= k) & (F.col("offset") + F.col("length") <= F.length("seq")))
    return fit.select(F.concat("label", F.lit("/"), "source_id").alias("sample"), "source_id", F.substring("seq", F.col("offset") + 1, F.col("length")).alias("seq"))


def sampled_packs(cuts: DataFrame, index: DataFrame, repetitive: DataFrame, k: int) -> DataFrame:
    """By sample: windows, lookup k-mers, index rows and repetitive k-mers among them, estimated pairs."""
    w = lookup_windows(cuts, k, "sample").select("sample", "lookup_kmer")
    used = w.groupBy("sample", "lookup_kmer").agg(F.count(F.lit(1)).alias("windows"))
    sizes = index.groupBy("lookup_kmer").agg(F.count(F.lit(1)).alias("rows"))
    met = used.join(sizes, "lookup_kmer", "left").join(repetitive.select("lookup_kmer", F.lit(1).alias("often")).distinct(), "lookup_kmer", "left")
    g = met.groupBy("sample").agg(F.sum("windows").alias("windows"), F.count(F.lit(1)).alias("lookup_kmers"), F.coalesce(F.sum("rows"), F.lit(0)).alias("index_rows"), F.count("often").alias("repetitive"))
    return g.withColumn("estimated_pairs", F.col("windows") * F.col("index_rows"))


def longest_first(packs: DataFrame) -> DataFrame:
    return packs.orderBy(F.desc("estimated_pairs"), F.desc("windows"), F.desc("sample"))


def warm_requests(requests: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Requests with ``warm``: an earlier one had an equal key, so its state could be used again."""
    return requests.withColumn("warm", F.row_number().over(Window.partitionBy(*key).orderBy(ordinal)) > 1)


def timing_stats(runs: DataFrame, by: str, ms: Column) -> DataFrame:
    """Runs, sum, least, mean and largest time by ``by``."""
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.sum(ms).alias("total"), F.min(ms).alias("least"), (F.sum(ms) / F.count(ms)).alias("mean"), F.max(ms).alias("most"))


def against_control(stats: DataFrame, by: str, control: str) -> DataFrame:
    """Statistics with the difference of the total from the control's, and how many times faster the mean is."""
    c = stats.filter(F.col(by) == control).select(F.col("total").alias("control_total"), F.col("mean").alias("control_mean"))
    met = stats.join(F.broadcast(c))  # the control is one row
    return met.withColumns({"difference": F.col("total") - F.col("control_total"), "speedup": F.when(F.col("mean") != 0, F.col("control_mean") / F.col("mean"))}).drop("control_total", "control_mean")


def run_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, status) of artifacts (path, digest) of two runs: match, mismatch, missing_left or missing_right."""
    met = left.select("path", F.col("digest").alias("a"), F.lit(1).alias("in_a")).join(right.select("path", F.col("digest").alias("b"), F.lit(1).alias("in_b")), "path", "full")
    status = F.when(F.col("in_a").isNull(), "missing_left").when(F.col("in_b").isNull(), "missing_right").when(F.col("a").eqNullSafe(F.col("b")), "match").otherwise("mismatch")
    return met.select("path", status.alias("status"))
