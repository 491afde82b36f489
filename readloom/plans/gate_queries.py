"""Queries of strict readers, gates and sessions over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna
from ..operators import candidates as C
from ..operators import chains
from ..sources import records
from ..sources.scratch import materialize, scratch_path
from ..sources.tables import SEQUENCES_SQL, edges, table
from ..streaming import requests
from . import checks, diffs, gates, governance, planners, selectors
from .chain_sql import graph_steps

K, MOST = 17, 8


def _written(df, tag: str) -> str:
    """``df`` as a tab-separated record file in the shared folder."""
    path = scratch_path(df.sparkSession, tag)
    df.write.csv(path, sep="\t", header=False)
    return path


def _hit_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("query_pos"), F.col("l_partkey").alias("kmer"), (F.col("l_suppkey") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("target_id"), F.col("l_quantity").cast("long").alias("target_pos"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("target_strand"))


def strict_records(spark, sf):
    """Candidate records written as text and read back by the strict reader."""
    hits = _hit_rows(spark, sf).filter("query_id != 0 and target_id != 0")
    return records.read_strict(spark, _written(hits, "candidates"), "candidate-record-v1")


def record_faults(spark, sf):
    """Lines with one fault each, by line number of the order."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = F.col("l_linenumber")
    line = F.concat_ws("\t", F.when(n == 1, F.concat(F.lit("+"), "l_orderkey")).when(n == 2, F.lit("0")).otherwise(F.col("l_orderkey").cast("string")), F.when(n == 3, F.lit("-4")).otherwise(n.cast("string")), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.lit("7"), F.when(n == 4, F.lit("x")).when(n != 5, F.lit("+")))
    path = scratch_path(spark, "faulty")
    li.select(line.alias("line")).write.text(path)
    return records.record_faults(spark, path, "candidate-record-v1").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def window_sources(spark, sf):
    """String windows, an index of them and a repetitive set, read from files, encoded and joined."""
    e = edges(spark, sf)
    cut = lambda start: F.substring("seq", start, K)
    own = e.filter(F.length("seq") >= 60).select(F.col("edge_seq_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("pos"), cut(p + 1).alias("s")) for p in (0, 10, 20, 30)])).alias("w"))
    queries = records.read_strict(spark, _written(own.select("id", "w.pos", "w.s"), "windows"), "query-window", K)
    index = records.read_strict(spark, _written(own.filter("id % 2 = 0").select((-F.col("id")).alias("id"), "w.pos", F.lit("-"), dna.reverse_complement(F.col("w.s"))), "index"), "index-window", K)
    often = records.read_repetitive(spark, _written(own.filter("id % 4 = 0 and w.pos = 10").select("w.s"), "often"), "repetitive-window", K)
    code = lambda c: dna.kmer_encode(dna.kmer_standard(F.col(c)), K)
    q = queries.select("query_id", "query_pos", dna.kmer_encode(F.col("sequence"), K).alias("query_kmer"), code("sequence").alias("lookup_kmer"))
    return C.kmer_join(q, index.select(code("sequence").alias("lookup_kmer"), "target_id", "target_pos", "target_strand"), often.select(code("sequence").alias("lookup_kmer")))


def _full_hits(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") * F.lit(10000000).cast("long") + F.col("l_partkey")).alias("source_order"), F.col("l_quantity").cast("long").alias("query_pos"), F.col("l_partkey").alias("query_kmer_repr"), F.col("l_partkey").alias("standard_kmer_repr"),
        F.lit(0).alias("standard_revcomp"), F.lit(0).alias("is_repetitive"), F.lit(3).cast("long").alias("kmer_freq"), (F.col("l_suppkey") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("target_edge_seq_id"), F.col("l_quantity").cast("long").alias("target_pos"),
    )


def full_query_hits(spark, sf):
    hits = records.full_query_hits(_full_hits(spark, sf))
    return hits.select("query_id", "source_order", "query_kmer_repr", "target_edge_seq_id", "query_pos", "match_order")


def bucket_hits(spark, sf):
    rows = _full_hits(spark, sf).select("query_id", "query_pos", F.col("query_kmer_repr").alias("standard_kmer_repr"), "target_edge_seq_id", "target_pos", F.col("source_order").alias("line_no"))
    return records.bucket_hits(rows).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("match_order") * F.col("line_no")).alias("order_sum"))


def sampled_records(spark, sf):
    """The first five lines of a file, in its order."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("target_id"), F.col("n_regionkey").cast("int").alias("target_len")).orderBy("target_id").coalesce(1)
    return records.read_sample(spark, _written(n, "targets"), "target", 5)


def index_extraction(spark, sf):
    """By read: windows, those of repetitive k-mers (filtered positions), and those the index has."""
    e = edges(spark, sf)
    index = C.kmer_index(e, K)
    windows = C.lookup_windows(e.select(F.col("edge_seq_id").alias("read_id"), "seq"), K).withColumnRenamed("read_id", "query_id")
    freq = C.kmer_frequency(index)
    met = windows.join(C.unless_large(freq), "lookup_kmer", "left")
    return met.groupBy("query_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("kmer_freq") > MOST).alias("filtered"), F.count_if(F.col("kmer_freq") <= MOST).alias("indexed"))


def _overlap_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    return li.select(
        F.col("l_suppkey").alias("cur_id"), (F.col("l_linenumber") * 10).alias("cur_begin"), (F.col("l_linenumber") * 10 + q * 4).alias("cur_end"), F.lit(300).alias("cur_len"),
        ((F.col("l_partkey") % 5 + F.col("l_suppkey") - 2) * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("ext_id"), (F.col("l_orderkey") % 90).cast("int").alias("ext_begin"), ((F.col("l_orderkey") % 90) + q * 3 + F.col("l_linenumber") * 12).cast("int").alias("ext_end"), F.lit(320).alias("ext_len"),
        F.col("l_orderkey").alias("score"), (q / 100).cast("float").alias("seq_divergence"), "l_orderkey", "l_linenumber",
    )


def overlap_tests(spark, sf):
    """Overlaps that pass the test, by ids' relation."""
    p = chains.ChainParams(min_overlap=40, max_overhang=60)
    kind = F.when(F.col("cur_id") == F.col("ext_id"), "same").when(F.col("cur_id") == -F.col("ext_id"), "reverse").otherwise("other")
    return _overlap_rows(spark, sf).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(chains.overlap_test(p)).alias("passed"), F.count_if(F.col("seq_divergence") < 0.25).alias("close"))


def raw_chain_inputs(spark, sf):
    """Chain-input filter and rank by place in the read over many raw overlaps."""
    o = _overlap_rows(spark, sf).withColumn("ext_len", F.when(F.col("l_linenumber") > 2, 1000).otherwise(F.col("ext_len")))
    found = chains.chain_inputs(o, 900, 100)
    return found.groupBy("cur_id").agg(F.count(F.lit(1)).alias("n"), F.max("order").alias("last_order"), F.sum(F.col("order") * F.col("cur_begin")).alias("order_sum"))


def boundary_replay(spark, sf):
    o = _overlap_rows(spark, sf)
    oracle = chains.chain_inputs(o, 900, 100).drop("order").filter("l_linenumber != 6")
    return governance.boundary_replay(o, oracle, long_edge=900, big_alignment=100)


def record_functions(spark, sf):
    o = _overlap_rows(spark, sf)
    c = F.col
    cr, er = c("cur_end") - c("cur_begin"), c("ext_end") - c("ext_begin")
    clock = F.concat((c("l_orderkey") % 5).cast("string"), F.lit(":"), F.lpad((c("l_orderkey") % 60).cast("string"), 2, "0"), F.when(c("l_orderkey") % 2 == 0, F.lit(":07")).otherwise(F.lit(".5")))
    return o.select(
        "l_orderkey", "l_linenumber", (cr).alias("cur_range"), dna.overhang(*(c(x) for x in ("cur_begin", "cur_end", "cur_len", "ext_begin", "ext_end", "ext_len"))).alias("overhang"),
        F.round(dna.kmer_divergence(c("cur_end") - c("cur_begin") - 3, cr, er, c("l_linenumber"), K).cast("double"), 4).alias("divergence"),
        F.round(dna.safe_ratio(cr, c("l_orderkey") % 3), 6).alias("ratio"), dna.elapsed_seconds(clock).alias("seconds"),
    )


def record_violations(spark, sf):
    o = _overlap_rows(spark, sf).withColumn("cur_len", F.lit(150)).withColumn("ext_len", F.lit(200))
    return records.violations(o, "overlap-range-v1").groupBy("broken").agg(F.count(F.lit(1)).alias("n"))


def attached_edges(spark, sf):
    """Every line with the supplier's nation; one without would end the job."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("edge"))
    return checks.attach(li, s, ["l_suppkey"], "edge").groupBy("edge").agg(F.count(F.lit(1)).alias("n"))


def unsupported_shapes(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    f = o.select((k % 3 == 0).alias("nucl_alignment"), (k % 5 == 0).alias("partition_bad_mappings"), (k % 7 == 0).alias("keep_alignment"), (k % 2 == 0).alias("only_max_ext"), (k % 4).alias("max_overlaps"))
    return gates.reason_counts(governance.supported_shapes(f))


def over_capacity(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("hits"))
    return governance.capacity_faults(g, "hits", 600)


def _decided(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    chosen = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return li, li.filter("l_returnflag != 'N'"), chosen


def bypass_plan(spark, sf):
    return governance.bypass(*_decided(spark, sf), ["l_orderkey", "l_linenumber", "l_returnflag"], "l_orderkey")


def consumption_parity(spark, sf):
    d = gates.ownership(*_decided(spark, sf), ["l_orderkey", "l_linenumber", "l_returnflag"], "l_orderkey")
    stated = spark.createDataFrame([("replaced", 0), ("kept", 0), ("other", 3)], "decision string, n long")
    return governance.consumption_parity(d, stated)


def substituted(spark, sf):
    """Rows of finished orders taken from a copy, after both were found equal."""
    li, _, chosen = _decided(spark, sf)
    rows = governance.verified_substitution(li, governance.rehydrated(li), chosen, "l_orderkey")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


def rehydrated_objects(spark, sf):
    """Rows written as text, cast back, gathered as objects by order and taken apart again, against the rows."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    again = governance.from_objects(governance.as_objects(governance.rehydrated(li), "l_orderkey"), "l_orderkey")
    return diffs.canonical_diff(li, again)


def injected_fault(spark, sf):
    """A lost first row is found by the gate after it."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return diffs.canonical_diff(o, governance.without_first(o, ["o_orderkey"]))


def mutation_canary(spark, sf):
    """Chain inputs rebuilt as rows by read, against those that were accepted less one kind."""
    o = _overlap_rows(spark, sf).drop("seq_divergence")
    rebuild = lambda x: x.select("cur_id", "ext_id", "score")
    return governance.mutation_canary(o, rebuild, rebuild(o).filter("ext_id > 0"))


def filled_placeholders(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.lit(None).cast("string").alias("c_name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return governance.fill_placeholders(o, c, "o_custkey", "c_name").groupBy("c_name").agg(F.count(F.lit(1)).alias("n"))


def audit_sample(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    listed = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return governance.audit_sample(e, listed, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def shadow_checks(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") - 1).alias("edge_id"), F.col("l_suppkey").alias("read_begin"), (F.col("l_returnflag") == "R").alias("passes"))
    return governance.shadow_checks(selectors.query_summary(rows, table(spark, sf, "region").select(F.col("r_regionkey").alias("edge_id"))))


def accounting_checks(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type")
    return governance.accounting_checks(planners.accounting(e, "user_id", "event_type"), e)


def guard_checks(spark, sf):
    o = table(spark, sf, "orders")
    stated = governance.checks_of(o, {"explicit_guard_mode": F.count(F.lit(1)) > 0, "validation_passed": F.min("o_orderkey") >= 0, "shadow_passed": F.max("o_orderkey") < 0})
    return governance.guard(stated)


def expected_counts(spark, sf):
    o = table(spark, sf, "region").select("r_regionkey")
    return governance.expectations(o, records=5, expected_digest="0")


def pack_diff(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    of = lambda df: df.groupBy("l_orderkey").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "l_linenumber", F.col("l_quantity").cast("long").cast("string")))), ",")).alias("digest"))
    changed = li.filter("l_orderkey % 4 != 0").withColumn("l_quantity", F.col("l_quantity") + (F.col("l_orderkey") % 3 == 0).cast("int"))
    return governance.pack_diff(of(li.filter("l_orderkey % 5 != 0")), of(changed), "l_orderkey").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def packed_fixtures(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fixture"), "l_linenumber")
    params = table(spark, sf, "orders").select(F.col("o_orderkey").alias("fixture"), "o_orderstatus", "o_orderpriority")
    return governance.packed(li, params).groupBy(F.col("param_index").cast("int").alias("param_index")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("fixture").alias("fixtures"))


def budgeted(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("rows"))
    return governance.budgeted(n, "l_orderkey", "rows", 60, 5000)


def timing_totals(spark, sf):
    o = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("l_quantity"), "l_linenumber")
    return governance.timing_totals(o, ["l_partkey", "l_suppkey", "l_quantity", "l_linenumber"], F.col("l_returnflag") == "R")


def ledger_decisions(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), (F.col("event_type") != "view").alias("supported"), F.col("event_type").alias("decision"))
    return governance.decisions_of(e)


def shape_ids(spark, sf):
    return governance.ids_by_shape(table(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey")


def fixture_order(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("query_id")).agg(F.count(F.lit(1)).alias("candidate_records"))
    return governance.fixtures_in_order(g).withColumn("place", F.col("place").cast("int"))


def ordered_matches(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return governance.ordered_matches(o, o.withColumn("o_custkey", F.col("o_custkey") + (F.col("o_orderkey") % 6 == 0).cast("int")).filter("o_orderkey % 10 != 0"), "o_orderkey", ["o_custkey"])


def unproved_semantics(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    states = o.select(k.alias("query_id"), F.when(k % 2 == 0, "full-query-hits").otherwise("minimizer-buckets").alias("source"), F.when(k % 3 == 0, "match").otherwise("mismatch").alias("status"), F.when(k % 5 == 0, "match").otherwise("mismatch").alias("geometry"))
    return governance.unproved(states).groupBy("unproved").agg(F.count(F.lit(1)).alias("n"))


def cached_answers(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("request_key"))
    known = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("request_key"), F.lit("known").alias("answer"))
    answers, _ = requests.cached_answers(e, known, lambda keys: keys.withColumn("answer", F.concat(F.lit("new "), F.col("request_key"))))
    return answers.groupBy("cached", F.substring("answer", 1, 3).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def session_ledger(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_type") == "purchase").alias("selected"))
    path = scratch_path(spark, "ledger")
    requests.append_ledger(e.filter("event_id % 2 = 0"), path, "selected-only-v0", 0)
    requests.append_ledger(e.filter("event_id % 2 = 1"), path, "full-v0", 1)
    requests.append_ledger(e.filter("event_id % 2 = 1"), path, "full-v0", 1)  # a retry
    return requests.read_session_ledger(spark, path, "event_id long, selected boolean").groupBy("selected").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def crossover(spark, sf):
    li = table(spark, sf, "lineitem")
    runs = li.select(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("size"), F.col("l_partkey").cast("double").alias("control_ms"), (F.col("l_suppkey") * F.col("l_quantity")).alias("ms"))
    return gates.crossover(runs)


GRAPH = chains.GraphParams(max_jump=80, max_read_overlap=10, min_overlap=20, max_separation=5, long_gap=20, gap_unit=10)


def _edge_overlaps(spark, sf):
    li = table(spark, sf, "lineitem")
    q, part = F.col("l_quantity").cast("int"), F.col("l_partkey")
    return li.select(
        (F.col("l_linenumber") * F.lit(100000000).cast("long") + part * 1000 + F.col("l_suppkey") % 1000).alias("candidate_id"), F.col("l_orderkey").alias("read_id"), (F.col("l_linenumber") * 40 + q % 5).cast("int").alias("read_begin"), (F.col("l_linenumber") * 40 + q % 5 + q).cast("int").alias("read_end"), F.lit(400).alias("read_len"),
        part.alias("edge_id"), (part % 3).cast("int").alias("edge_left_node"), (F.col("l_suppkey") % 3).cast("int").alias("edge_right_node"), part.alias("edge_seq_id"), (F.col("l_suppkey") % 90).cast("int").alias("edge_begin"), F.lit(95).alias("edge_end"), (F.lit(100) + (part % 7) * 20).cast("int").alias("edge_len"),
        q.alias("score"), (q / 100).alias("seq_divergence"),
    )


def read_alignments(spark, sf):
    """Chains along a graph of many reads, accepted by a given divergence of each chain."""
    found = materialize(chains.chain_read_alignments(_edge_overlaps(spark, sf), GRAPH), "chains")  # used twice
    given = found.select("read_id", "chain_id").distinct().withColumn("divergence", ((F.col("read_id") + F.col("chain_id")) % 10) / 20)
    return chains.read_alignments(found, given)


def _raw_overlaps(spark, sf):
    """The same edge overlaps as raw overlaps, with the nodes of their edges."""
    e = _edge_overlaps(spark, sf)
    return e.select(
        F.col("read_id").alias("cur_id"), F.col("read_begin").alias("cur_begin"), F.col("read_end").alias("cur_end"), F.col("read_len").alias("cur_len"), F.col("edge_id").alias("ext_id"), F.col("edge_begin").alias("ext_begin"), F.col("edge_end").alias("ext_end"), F.col("edge_len").alias("ext_len"),
        "score", "seq_divergence", "edge_left_node", "edge_right_node",
    )


def _rebuilt(inputs):
    """Chain inputs through graph chaining, acceptance and the gate on divergence: (read_id, chain_id, segment_id, edge_seq_id, score)."""
    e = inputs.select(
        F.col("order").cast("long").alias("candidate_id"), F.col("cur_id").alias("read_id"), F.col("cur_begin").alias("read_begin"), F.col("cur_end").alias("read_end"), F.col("cur_len").alias("read_len"), F.col("ext_id").alias("edge_id"), "edge_left_node", "edge_right_node",
        F.col("ext_id").alias("edge_seq_id"), F.col("ext_begin").alias("edge_begin"), F.col("ext_end").alias("edge_end"), F.col("ext_len").alias("edge_len"), "score", "seq_divergence",
    )
    found = materialize(chains.chain_read_alignments(e, GRAPH), "chains")
    given = found.select("read_id", "chain_id").distinct().withColumn("divergence", ((F.col("read_id") + F.col("chain_id")) % 10) / 20)
    return chains.read_alignments(found, given).select("read_id", "chain_id", "segment_id", "edge_seq_id", "score")


def chain_canary(spark, sf):
    """Chains rebuilt from raw overlaps, by filter, order, graph chaining and acceptance, against an accepted slice in which
    one segment of some reads was changed: the canary must find these, and no others."""
    raw = _raw_overlaps(spark, sf)
    changed = (F.col("read_id") % 97 == 0) & (F.col("chain_id") == 0) & (F.col("segment_id") == 0)
    accepted = _rebuilt(chains.chain_inputs(raw)).withColumn("score", F.col("score") + changed.cast("int"))
    return governance.mutation_canary(raw, _rebuilt, materialize(accepted, "accepted"))


def placeholder_chains(spark, sf):
    """Reads whose own chaining was left out, filled with the chains that were rebuilt for them."""
    rebuilt = materialize(_rebuilt(chains.chain_inputs(_raw_overlaps(spark, sf))), "rebuilt")
    value = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("chain_id", "segment_id", "edge_seq_id"))), lambda x: F.concat_ws(":", x["chain_id"].cast("string"), x["edge_seq_id"].cast("string"))))
    chained = rebuilt.groupBy("read_id").agg(value.alias("chains"))
    skipped = rebuilt.select("read_id").distinct().withColumn("chains", F.lit(None).cast("string"))
    return governance.fill_placeholders(skipped, chained, "read_id", "chains")


def queries() -> dict:
    found = [
        read_alignments, chain_canary, placeholder_chains,
        strict_records, record_faults, window_sources, full_query_hits, bucket_hits, sampled_records, index_extraction, overlap_tests, raw_chain_inputs, boundary_replay, record_functions, record_violations, attached_edges, unsupported_shapes, over_capacity, bypass_plan, consumption_parity,
        substituted, rehydrated_objects, injected_fault, mutation_canary, filled_placeholders, audit_sample, shadow_checks, accounting_checks, guard_checks, expected_counts, pack_diff, packed_fixtures, budgeted, timing_totals, ledger_decisions, shape_ids, fixture_order, ordered_matches,
        unproved_semantics, cached_answers, session_ledger, crossover,
    ]
    return {f.__name__: f for f in found}


_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_CODE = "CAST(list_sum(list_transform(range(0, 17), lambda i: CAST(strpos('ACGT', substr({0}, CAST(i + 1 AS BIGINT), 1)) - 1 AS BIGINT) * CAST(4 ** (16 - i) AS BIGINT))) AS BIGINT)"
_HITS = "h AS (SELECT l_orderkey AS query_id, l_linenumber * CAST(10000000 AS BIGINT) + l_partkey AS source_order, CAST(l_quantity AS BIGINT) AS query_pos, l_partkey AS query_kmer_repr, l_suppkey * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS target_edge_seq_id FROM lineitem)"
_MATCHED = f"""{_HITS}, m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN target_edge_seq_id > 0 THEN 2 * (target_edge_seq_id - 1) ELSE -2 * target_edge_seq_id - 1 END, query_pos, source_order) - 1 AS match_order FROM h WHERE query_id <> target_edge_seq_id)"""
_OVERLAPS = """o AS (SELECT l_orderkey, l_linenumber, l_suppkey AS cur_id, l_linenumber * 10 AS cur_begin, l_linenumber * 10 + CAST(l_quantity AS INTEGER) * 4 AS cur_end, 300 AS cur_len,
  (l_partkey % 5 + l_suppkey - 2) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS ext_id, l_orderkey % 90 AS ext_begin, l_orderkey % 90 + CAST(l_quantity AS INTEGER) * 3 + l_linenumber * 12 AS ext_end, 320 AS ext_len,
  CAST(CAST(l_quantity AS INTEGER) / 100 AS FLOAT) AS seq_divergence, l_orderkey AS score FROM lineitem)"""
_INPUTS = "(ext_len < 900 OR least(cur_end - cur_begin, ext_end - ext_begin) > 100)"
_DECIDED = """d AS (SELECT CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'kept' WHEN l_returnflag <> 'N' THEN 'replaced' ELSE 'selected_missing' END AS decision FROM lineitem)"""


_GRAPH = f"""e AS (
  SELECT l_orderkey AS read_id, l_linenumber * CAST(100000000 AS BIGINT) + l_partkey * 1000 + l_suppkey % 1000 AS cand, CAST(l_linenumber * 40 + CAST(l_quantity AS INTEGER) % 5 AS INTEGER) AS b, CAST(l_linenumber * 40 + CAST(l_quantity AS INTEGER) % 5 + CAST(l_quantity AS INTEGER) AS INTEGER) AS z,
    l_partkey AS edge, l_partkey % 3 AS ln, l_suppkey % 3 AS rn, CAST(l_suppkey % 90 AS INTEGER) AS eb, 95 AS ee, CAST(100 + l_partkey % 7 * 20 AS INTEGER) AS el, CAST(l_quantity AS INTEGER) AS sc FROM lineitem
), {graph_steps(GRAPH)}, kept AS (
  SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY chain_id) - 1 AS again FROM chain WHERE ((read_id + chain_id) % 10) / 20 < 0.25
), segments AS (SELECT read_id, again, x, unnest(path) AS k, unnest(range(0, len(path))) AS segment_id FROM kept)"""
# The same with the places of chain inputs, which equal begins can order in another way.
_IN_ORDER = _GRAPH.replace("l_linenumber * CAST(100000000 AS BIGINT) + l_partkey * 1000 + l_suppkey % 1000 AS cand", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 40 + CAST(l_quantity AS INTEGER) % 5, l_partkey, l_suppkey % 90, l_linenumber * 40 + CAST(l_quantity AS INTEGER) % 5 + CAST(l_quantity AS INTEGER)) AS cand")


def oracle_sql() -> dict[str, str]:
    return {
        "read_alignments": f"""WITH RECURSIVE {_GRAPH} SELECT CAST(again AS INTEGER) AS chain_id, CAST(segment_id AS INTEGER) AS segment_id, read_id, x[k].b AS read_begin, x[k].z AS read_end, 400 AS read_len, x[k].edge AS edge_id, x[k].edge AS edge_seq_id, x[k].eb AS edge_begin, 95 AS edge_end, x[k].el AS edge_len, x[k].sc AS score, x[k].sc / 100 AS seq_divergence FROM segments""",
        "chain_canary": f"""WITH RECURSIVE {_IN_ORDER}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE read_id % 97 = 0 AND again = 0 AND segment_id = 0) AS c FROM segments)
SELECT n AS left_records, n AS right_records, c AS missing, c AS extra, CASE WHEN c = 0 THEN 'match' ELSE 'mismatch' END AS status FROM n""",
        "placeholder_chains": f"WITH RECURSIVE {_IN_ORDER} SELECT read_id, string_agg(again || ':' || x[k].edge, ',' ORDER BY again, segment_id) AS chains FROM segments GROUP BY 1",
        "strict_records": "SELECT l_orderkey AS query_id, CAST(l_linenumber AS BIGINT) AS query_pos, l_partkey AS kmer, l_suppkey * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS target_id, CAST(l_quantity AS BIGINT) AS target_pos, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS target_strand FROM lineitem WHERE l_orderkey <> 0 AND l_suppkey <> 0",
        "record_faults": """SELECT fault, count(*) AS n FROM (SELECT CASE WHEN l_linenumber = 5 THEN 'fields' WHEN l_linenumber = 1 THEN 'number' WHEN l_linenumber = 2 THEN 'id' WHEN l_orderkey = 0 OR l_suppkey = 0 THEN 'id' WHEN l_linenumber = 3 THEN 'position' WHEN l_linenumber = 4 THEN 'strand' END AS fault FROM lineitem) WHERE fault IS NOT NULL GROUP BY 1""",
        "window_sources": f"""WITH {SEQUENCES_SQL}, w AS (SELECT edge_seq_id AS id, v.p AS pos, substr(seq, CAST(v.p + 1 AS BIGINT), 17) AS s FROM edges, (VALUES (0), (10), (20), (30)) v(p) WHERE len(seq) >= 60),
x AS (SELECT id, pos, s, least(s, {_RC.format('s')}) AS lk FROM w)
SELECT q.id AS query_id, CAST(q.pos AS BIGINT) AS query_pos, {_CODE.format('q.s')} AS kmer, -i.id AS target_id, CAST(i.pos AS BIGINT) AS target_pos, '-' AS target_strand
FROM x q JOIN x i ON q.lk = i.lk AND i.id % 2 = 0 WHERE q.lk NOT IN (SELECT lk FROM x WHERE id % 4 = 0 AND pos = 10)""",
        "full_query_hits": f"WITH {_MATCHED} SELECT query_id, source_order, query_kmer_repr, target_edge_seq_id, query_pos, CAST(match_order AS INTEGER) AS match_order FROM m",
        "bucket_hits": f"WITH {_MATCHED} SELECT query_id, count(*) AS hits, CAST(sum(match_order * source_order) AS BIGINT) AS order_sum FROM m GROUP BY 1",
        "sampled_records": "SELECT n_nationkey AS target_id, CAST(n_regionkey AS INTEGER) AS target_len FROM nation ORDER BY n_nationkey LIMIT 5",
        "index_extraction": f"""WITH {SEQUENCES_SQL}, ways AS (SELECT edge_seq_id AS id, seq FROM edges UNION ALL SELECT -edge_seq_id, {_RC.format('seq')} FROM edges),
iw AS (SELECT id, substr(seq, CAST(p + 1 AS BIGINT), 17) AS w FROM (SELECT id, seq, unnest(range(0, len(seq) - 16)) AS p FROM ways WHERE len(seq) >= 17)),
k AS (SELECT id, least(w, {_RC.format('w')}) AS lk FROM iw), f AS (SELECT lk, count(*) AS n FROM k GROUP BY 1)
SELECT k.id AS query_id, count(*) AS windows, count(*) FILTER (WHERE f.n > 8) AS filtered, count(*) FILTER (WHERE f.n <= 8) AS indexed FROM k JOIN f USING (lk) WHERE k.id > 0 GROUP BY 1""",
        "overlap_tests": f"""WITH {_OVERLAPS}, t AS (SELECT *, cur_end - cur_begin AS cr, ext_end - ext_begin AS er FROM o)
SELECT CASE WHEN cur_id = ext_id THEN 'same' WHEN cur_id = -ext_id THEN 'reverse' ELSE 'other' END AS kind, count(*) AS n,
  count(*) FILTER (WHERE cr >= 40 AND er >= 40 AND abs(cr - er) <= 0.5 * least(cr, er) AND NOT (cur_id = ext_id AND least(cur_end, ext_end) - greatest(cur_begin, ext_begin) > cr / 2)
    AND NOT (cur_id = -ext_id AND least(cur_end, ext_len - ext_begin) - greatest(cur_begin, ext_len - ext_end) > cr / 2) AND greatest(least(cur_begin, ext_begin), least(cur_len - cur_end, ext_len - ext_end)) <= 60) AS passed,
  count(*) FILTER (WHERE seq_divergence < 0.25) AS close FROM t GROUP BY 1""",
        "raw_chain_inputs": f"""WITH {_OVERLAPS}, c AS (SELECT *, row_number() OVER (PARTITION BY cur_id ORDER BY cur_begin, ext_id, ext_begin, cur_end) - 1 AS r FROM (SELECT * REPLACE (CASE WHEN l_linenumber > 2 THEN 1000 ELSE ext_len END AS ext_len) FROM o) WHERE {_INPUTS})
SELECT cur_id, count(*) AS n, CAST(max(r) AS INTEGER) AS last_order, CAST(sum(r * cur_begin) AS BIGINT) AS order_sum FROM c GROUP BY 1""",
        "boundary_replay": f"""WITH {_OVERLAPS}, c AS (SELECT * FROM o WHERE {_INPUTS}) SELECT count(*) AS left_records, count(*) FILTER (WHERE l_linenumber <> 6) AS right_records, count(*) FILTER (WHERE l_linenumber = 6) AS missing, CAST(0 AS BIGINT) AS extra, CASE WHEN count(*) FILTER (WHERE l_linenumber = 6) = 0 THEN 'match' ELSE 'mismatch' END AS status FROM c""",
        "record_functions": f"""WITH {_OVERLAPS}, t AS (SELECT *, cur_end - cur_begin AS cr, greatest(cur_end - cur_begin, ext_end - ext_begin) - l_linenumber AS n FROM o)
SELECT l_orderkey, l_linenumber, cr AS cur_range, greatest(least(cur_begin, ext_begin), least(cur_len - cur_end, ext_len - ext_end)) AS overhang,
  CASE WHEN n > 0 THEN round(ln(1 / least((cr - 3) / n, 1.0)) / 17, 4) END AS divergence, CASE WHEN l_orderkey % 3 <> 0 THEN round(cr / (l_orderkey % 3), 6) END AS ratio,
  CAST(CASE WHEN l_orderkey % 2 = 0 THEN (l_orderkey % 5) * 3600 + (l_orderkey % 60) * 60 + 7 ELSE (l_orderkey % 5) * 60 + l_orderkey % 60 + 0.5 END AS DOUBLE) AS seconds FROM t""",
        "record_violations": f"""WITH {_OVERLAPS} SELECT broken, count(*) AS n FROM (SELECT CASE WHEN cur_id = 0 OR ext_id = 0 THEN 'id' WHEN NOT (0 <= cur_begin AND cur_begin <= cur_end AND cur_end < 150) THEN 'cur' WHEN NOT (0 <= ext_begin AND ext_begin <= ext_end AND ext_end < 200) THEN 'ext' END AS broken FROM o) WHERE broken IS NOT NULL GROUP BY 1""",
        "attached_edges": "SELECT s_nationkey AS edge, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
        "unsupported_shapes": """SELECT * FROM (SELECT 'base_alignment' AS reason, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'trimming', count(*) FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'kept_alignment', count(*) FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'several_overlaps_a_target', count(*) FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT 'limited_overlaps', count(*) FROM orders WHERE o_orderkey % 4 <> 0) WHERE n > 0""",
        "over_capacity": "SELECT l_suppkey, count(*) AS hits FROM lineitem GROUP BY 1 HAVING count(*) > 600",
        "bypass_plan": f"WITH {_DECIDED} SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'replaced') AS eligible, count(*) FILTER (WHERE decision <> 'replaced') AS residual, true AS ties_out FROM d",
        "consumption_parity": f"WITH {_DECIDED}, f AS (SELECT decision, count(*) AS n FROM d GROUP BY 1), s AS (SELECT * FROM (VALUES ('replaced', 0), ('kept', 0), ('other', 3)) v(decision, n)) SELECT decision, CAST(coalesce(s.n, 0) AS BIGINT) AS stated, coalesce(f.n, 0) AS found, coalesce(s.n, 0) = coalesce(f.n, 0) AS same FROM s FULL JOIN f USING (decision)",
        "substituted": "SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1",
        "rehydrated_objects": "SELECT count(*) AS left_records, count(*) AS right_records, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, 'match' AS status FROM lineitem",
        "injected_fault": "SELECT count(*) AS left_records, count(*) - 1 AS right_records, CAST(1 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, 'mismatch' AS status FROM orders",
        "mutation_canary": f"WITH {_OVERLAPS}, c AS (SELECT * FROM o WHERE {_INPUTS}) SELECT count(*) AS left_records, count(*) FILTER (WHERE ext_id > 0) AS right_records, count(*) FILTER (WHERE ext_id <= 0) AS missing, CAST(0 AS BIGINT) AS extra, CASE WHEN count(*) FILTER (WHERE ext_id <= 0) = 0 THEN 'match' ELSE 'mismatch' END AS status FROM c",
        "filled_placeholders": "SELECT c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "audit_sample": "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR NOT EXISTS (SELECT 1 FROM labels WHERE toxic = 1) GROUP BY 1",
        "shadow_checks": """SELECT 'chain_inputs_and_filtered' AS "check", true AS passed UNION ALL SELECT 'states_of_edges', true UNION ALL SELECT 'all_edges_resolve', count(*) FILTER (WHERE l_linenumber > 1 AND l_linenumber - 1 NOT IN (SELECT r_regionkey FROM region)) = 0 FROM lineitem""",
        "accounting_checks": "SELECT CAST(level AS BIGINT) AS level, (SELECT count(*) FROM events) AS total, true AS passed FROM (VALUES (0), (1), (2)) v(level)",
        "guard_checks": """SELECT * FROM (VALUES ('explicit_guard_mode', true), ('validation_passed', true), ('shadow_mode_selected', false), ('shadow_passed', false), ('fixture_count_matches_request', false), ('audit_metadata_available', false)) v("check", passed)""",
        "expected_counts": """SELECT 'records' AS "check", count(*) = 5 AS passed FROM region UNION ALL SELECT 'digest', false""",
        "pack_diff": """WITH a AS (SELECT l_orderkey AS k, string_agg(l_linenumber || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber || ':' || CAST(l_quantity AS BIGINT)) AS d FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
b AS (SELECT l_orderkey AS k, string_agg(l_linenumber || ':' || (CAST(l_quantity AS BIGINT) + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END), ',' ORDER BY l_linenumber || ':' || (CAST(l_quantity AS BIGINT) + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END)) AS d FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1)
SELECT CASE WHEN a.d IS NULL THEN 'missing_left' WHEN b.d IS NULL THEN 'missing_right' WHEN a.d = b.d THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY 1""",
        "packed_fixtures": """WITH p AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus, o_orderpriority) - 1 AS i FROM orders) SELECT CAST(i AS INTEGER) AS param_index, count(*) AS rows, count(DISTINCT o_orderkey) AS fixtures FROM lineitem JOIN p ON l_orderkey = o_orderkey GROUP BY 1""",
        "budgeted": """WITH g AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1),
f AS (SELECT list_reduce(list_prepend({'k': CAST(-1 AS BIGINT), 's': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[])}, list({'k': k, 's': s, 'n': CAST(0 AS BIGINT), 'ids': CAST([] AS BIGINT[])} ORDER BY k)),
  lambda a, x: CASE WHEN a.n < 60 AND a.s + x.s <= 5000 THEN {'k': x.k, 's': a.s + x.s, 'n': a.n + 1, 'ids': list_append(a.ids, x.k)} ELSE a END) AS r FROM g)
SELECT unnest(r.ids) AS l_orderkey FROM f""",
        "timing_totals": "SELECT " + ", ".join(f"CAST(sum({e}) AS BIGINT) AS all_{c}, CAST(coalesce(sum({e}) FILTER (WHERE l_returnflag = 'R'), 0) AS BIGINT) AS chosen_{c}" for c, e in (("l_partkey", "l_partkey"), ("l_suppkey", "l_suppkey"), ("l_quantity", "CAST(l_quantity AS BIGINT)"), ("l_linenumber", "l_linenumber"))) + " FROM lineitem",
        "ledger_decisions": "SELECT user_id AS query_id, count(*) FILTER (WHERE event_type = 'view') AS unsupported, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS decisions FROM events GROUP BY 1",
        "shape_ids": "SELECT s_nationkey, count(*) AS n, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS ids FROM supplier GROUP BY 1",
        "fixture_order": "SELECT query_id, candidate_records, CAST(row_number() OVER (ORDER BY candidate_records DESC, query_id) - 1 AS INTEGER) AS place FROM (SELECT l_suppkey AS query_id, count(*) AS candidate_records FROM lineitem GROUP BY 1)",
        "ordered_matches": "SELECT count(*) AS left_rows, count(*) FILTER (WHERE o_orderkey % 10 <> 0) AS right_rows, count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_orderkey % 6 <> 0) AS same_place FROM orders",
        "unproved_semantics": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'fields_beside_the_key' WHEN o_orderkey % 5 = 0 THEN 'score_and_divergence' WHEN o_orderkey % 2 = 0 THEN 'order_of_equal_hits' ELSE 'hits_beside_minimizers' END AS unproved, count(*) AS n FROM orders GROUP BY 1",
        "cached_answers": "SELECT user_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS cached, CASE WHEN user_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'kno' ELSE 'new' END AS kind, count(*) AS n FROM events GROUP BY 1, 2",
        "session_ledger": "SELECT event_type = 'purchase' AS selected, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 2 = 1 OR event_type = 'purchase' GROUP BY 1",
        "crossover": "SELECT mode, CAST(min(size) FILTER (WHERE c > o) AS INTEGER) AS first_size FROM (SELECT l_returnflag AS mode, l_linenumber AS size, avg(l_partkey) AS c, avg(l_suppkey * l_quantity) AS o FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    }
