"""Queries of checks, selectors and dumps over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import chains
from ..operators.grouping import dealt
from ..sources import dumps
from ..sources.scratch import materialize
from ..sources.tables import SEQUENCES_SQL, edges, table
from . import checks, digests, diversity, selectors, summaries

K, MOST, SAMPLES = 17, 8, ["head:0:64", "middle:20:100", "rest:10:full"]


def order_checks(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("place"), "l_partkey")
    return checks.order_checks(dealt(li, "l_orderkey"), "l_orderkey", "place", "l_partkey")


def broken_groups(spark, sf):
    return checks.broken_groups(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


def source_offsets(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("size"))
    return checks.with_offsets(li, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "size"], F.col("size")).groupBy("l_suppkey").agg(F.max("source_order").alias("last_order"), F.sum("offset").alias("offsets"), F.max("offset").alias("last_offset"))


def middle_rows(spark, sf):
    return checks.middle_rows(table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey"), "o_orderpriority", "o_totalprice", "o_orderkey")


def scaled_metric(spark, sf):
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return checks.scaled(s, "s_nationkey", "s_acctbal").select("s_suppkey", F.round("scaled", 6).alias("scaled"))


def bag_digest(spark, sf):
    return checks.digest(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"))


def bag_excess(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linenumber")
    return checks.excess(li.filter("l_linenumber <= 2").drop("l_linenumber"), li.filter("l_linenumber > 2").drop("l_linenumber"))


def places_in_ranges(spark, sf):
    li = table(spark, sf, "lineitem")
    ranges = li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("begin"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return checks.places_in_ranges(ranges, li.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("position")), "id", 64)


def identity_states(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"), "lang")
    packed = d.select("read_id", F.when(F.col("lang") == "en", F.upper("seq")).otherwise(F.col("seq")).alias("seq"))
    return checks.identity_states(packed, d.filter("lang != 'de'")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _summary(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") - 1).alias("edge_id"), F.col("l_suppkey").alias("read_begin"), (F.col("l_returnflag") == "R").alias("passes"))
    return selectors.query_summary(dealt(rows, "query_id"), table(spark, sf, "region").select(F.col("r_regionkey").alias("edge_id")))


def query_summary(spark, sf):
    return _summary(spark, sf)


def _supported(spark, sf):
    cost = table(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("query_id")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cost"))
    return selectors.pack_support(_summary(spark, sf), 5, 3).join(cost, "query_id")


def pack_support(spark, sf):
    return _supported(spark, sf).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def target_plan(spark, sf):
    return selectors.plan_targets(_supported(spark, sf), "cost", 20).select("query_id", "raw", "chain_inputs", "cost")


def target_gain(spark, sf):
    s = _supported(spark, sf)
    return selectors.target_gain(s, selectors.plan_targets(s, "cost", 20), "cost").withColumn("share", F.round("share", 6))


def pack_plan(spark, sf):
    supported = materialize(_supported(spark, sf), "supported")  # used five times
    return selectors.plan_pack(supported, 6).select("query_id", "turn", "raw", "filtered")


def shape_batches(spark, sf):
    s = _summary(spark, sf).withColumnsRenamed({"query_id": "fixture", "raw": "rows"})
    return selectors.shape_batches(s, ["chain_inputs", "edge_live"], 6)


def sampled_packs(spark, sf):
    e = edges(spark, sf)
    index = C.kmer_index(e, K)
    cuts = selectors.cut_samples(e.select(F.col("edge_seq_id").alias("source_id"), "seq"), SAMPLES, K)
    return selectors.sampled_packs(cuts, index, C.repetitive_kmers(index, MOST), K)


def warm_requests(spark, sf):
    e = selectors.warm_requests(table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")
    return e.groupBy("event_type").agg(F.count_if("warm").alias("warm"), F.count_if(~F.col("warm")).alias("cold"))


def timing_stats(spark, sf):
    stats = selectors.timing_stats(table(spark, sf, "events"), "event_type", F.round(F.col("value") * 100).cast("long"))
    out = selectors.against_control(stats, "event_type", "view")
    return out.withColumns({"mean": F.round("mean", 6), "speedup": F.round("speedup", 6)})


def run_diff(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), "o_orderstatus", F.col("o_custkey").alias("digest"))
    right = o.filter("o_orderstatus != 'F'").withColumn("digest", F.col("digest") + F.when(F.col("path") % 7 == 0, 1).otherwise(0))
    return selectors.run_diff(o.filter("o_orderstatus != 'P'"), right).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def node_labels(spark, sf):
    return dumps.node_labels(edges(spark, sf).select(F.col("edge_seq_id").alias("edge_id"), F.col("left_node").alias("start_node"), F.col("right_node").alias("end_node")))


def log_spans(spark, sf):
    """Events written as log lines and read back."""
    e = table(spark, sf, "events")
    text = F.when(F.col("event_type") == "view", F.lit("Aligning reads to the graph")).when(F.col("event_type") == "click", F.lit("Aligned read sequence: 1 / 2")).otherwise(F.concat(F.lit(">>>STAGE: "), F.col("event_type")))
    lines = e.select(F.col("user_id").alias("run"), F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] INFO: "), text).alias("line"))
    return dumps.log_spans(dumps.log_events(lines))


def complement_chains(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.lit(0).alias("chain_id"), (F.col("l_linenumber") - 1).alias("segment_id"), F.col("l_linenumber").alias("read_begin"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("read_end"), F.lit(100).alias("read_len"),
        F.col("l_suppkey").alias("edge_id"), F.col("l_suppkey").alias("edge_seq_id"), F.lit(3).alias("edge_begin"), F.col("l_quantity").cast("int").alias("edge_end"), F.lit(60).alias("edge_len"),
    )
    return chains.with_complements(li)


def connectable(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("candidate_id"), (F.col("l_linenumber") * 40).alias("read_begin"), (F.col("l_linenumber") * 40 + F.col("l_quantity").cast("int")).alias("read_end"),
        (F.col("l_partkey") % 3).alias("edge_left_node"), ((F.col("l_partkey") + 1) % 3).alias("edge_right_node"), (F.col("l_suppkey") % 50).alias("edge_begin"), F.lit(60).alias("edge_end"), F.lit(100).alias("edge_len"),
    )
    return chains.connectable(li, chains.GraphParams(max_jump=80, max_read_overlap=10)).groupBy("read_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("before").alias("before"), F.sum("after").alias("after"))


def unit_digests(spark, sf):
    """The hash of every supplier's lines as a canonical file would have them."""
    return digests.unit_digests(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"])


def whole_digest(spark, sf):
    return digests.whole_digest(unit_digests(spark, sf), "l_suppkey")


DIVERSE = ["fixture_rows", "quantity", "lines", "orders"]


def diverse_fixtures(spark, sf):
    """Sixteen parts that differ most by four metrics."""
    li = table(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_partkey").alias("query_id")).agg(F.count(F.lit(1)).alias("fixture_rows"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"), F.count_distinct("l_orderkey").alias("orders"))
    return diversity.diverse(g.withColumn("fixture", F.concat(F.lit("f"), "query_id")), DIVERSE, 16, ["quantity", "lines"], "fixture")


def distinct_keys(spark, sf):
    """The set of (part, supplier) of a bag, with how often each was in it."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    return checks.as_set(li, ["l_partkey", "l_suppkey"])


def target_checks(spark, sf):
    """The named checks of the target plan, against a boundary of a million and a warm request that took too long."""
    plan = target_plan(spark, sf)
    return summaries.target_checks(plan, "cost", 100_000_000, 5.0, 1e12)


def _skips(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    selected = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("query_id"))
    key, ms = F.col("l_orderkey").alias("query_id"), lambda c: F.col(c).cast("long")
    control = li.filter("l_linenumber < 4").select(key, ms("l_partkey").alias("chain"), ms("l_suppkey").alias("divergence"))
    skipped = li.filter("l_linenumber >= 4").select(key, ms("l_linenumber").alias("placeholder"), ms("l_quantity").alias("rebuild"), ms("l_suppkey").alias("compare"), F.lit(1).cast("long").alias("substitution"), (ms("l_partkey") * 2).alias("request"), ms("l_quantity").alias("kernel"))
    return selected, control, skipped


def skip_timing(spark, sf):
    t = summaries.skip_timing(*_skips(spark, sf))
    return t.withColumns({c: F.round(c, 9) for c in ("cold_ratio", "hot_ratio")})


def skip_checks(spark, sf):
    return summaries.skip_checks(skip_timing(spark, sf))


def queries() -> dict:
    found = [order_checks, broken_groups, source_offsets, middle_rows, scaled_metric, bag_digest, bag_excess, places_in_ranges, identity_states, query_summary, pack_support, target_plan, target_gain, pack_plan, shape_batches, sampled_packs, warm_requests, timing_stats, run_diff, node_labels, log_spans, complement_chains, connectable, unit_digests, whole_digest, diverse_fixtures, distinct_keys, target_checks, skip_timing, skip_checks]
    return {f.__name__: f for f in found}


_SUMMARY = """s AS (
  SELECT l_orderkey AS query_id, count(*) AS raw, count(*) FILTER (WHERE l_returnflag = 'R') AS chain_inputs, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS begins,
         count(*) FILTER (WHERE l_returnflag <> 'R') AS filtered, count(*) FILTER (WHERE l_linenumber = 1) AS edge_zero,
         count(*) FILTER (WHERE l_linenumber > 1 AND l_linenumber - 1 IN (SELECT r_regionkey FROM region)) AS edge_live,
         count(*) FILTER (WHERE l_linenumber > 1 AND l_linenumber - 1 NOT IN (SELECT r_regionkey FROM region)) AS edge_unresolved
  FROM lineitem GROUP BY l_orderkey)"""
_COST = f"""{_SUMMARY}, c AS (SELECT s.*, cost FROM s JOIN (SELECT o_orderkey AS query_id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cost FROM orders GROUP BY 1) USING (query_id)),
fit AS (SELECT * FROM c WHERE raw BETWEEN 1 AND 5 AND chain_inputs BETWEEN 1 AND 3 AND begins = chain_inputs)"""
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


_UNITS = """u AS (SELECT l_suppkey, count(*) AS records, sha256(string_agg(l_orderkey || chr(9) || l_linenumber || chr(9) || CAST(l_quantity AS BIGINT) || chr(9) || l_returnflag, chr(10) ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag) || chr(10)) AS sha256 FROM lineitem GROUP BY 1)"""


_SKIPS = """sel AS (SELECT DISTINCT o_orderkey AS q FROM orders WHERE o_orderstatus = 'F'),
own AS (SELECT l_orderkey AS q, CAST(sum(l_partkey + l_suppkey) AS BIGINT) AS ms FROM lineitem WHERE l_linenumber < 4 GROUP BY 1),
a AS (SELECT count(*) AS selected, count(*) FILTER (WHERE ms IS NULL) AS missing, CAST(coalesce(sum(ms), 0) AS BIGINT) AS control_ms FROM sel LEFT JOIN own USING (q)),
b AS (SELECT count(DISTINCT l_orderkey) AS skipped, CAST(coalesce(sum(l_linenumber + CAST(l_quantity AS BIGINT) + l_suppkey + 1), 0) AS BIGINT) AS fill_ms, CAST(coalesce(sum(l_partkey * 2), 0) AS BIGINT) AS request_ms, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS kernel_ms
  FROM lineitem WHERE l_linenumber >= 4 AND l_orderkey IN (SELECT q FROM sel)),
t AS (SELECT *, request_ms + fill_ms AS cold_ms, kernel_ms + fill_ms AS hot_ms FROM a, b)"""


def _diverse_sql() -> str:
    """The rows taken are lists in one row; a step of the recursion adds the farthest one."""
    of = lambda text, glue=", ": glue.join(text.format(m=m, i=i) for i, m in enumerate(DIVERSE, 1))
    picks = " UNION ALL ".join(
        f"(SELECT {3 * i + j} AS o, fixture, c, '{m}_{name}' AS reason FROM s QUALIFY row_number() OVER (ORDER BY {m}, query_id) = {place})"
        for i, m in enumerate(DIVERSE) for j, (name, place) in enumerate((("min", "1"), ("max", "(SELECT n FROM ends)"), ("median", "(SELECT n // 2 + 1 FROM ends)")))
    )
    return f"""WITH RECURSIVE g AS (SELECT l_partkey AS query_id, 'f' || l_partkey AS fixture, count(*) AS fixture_rows, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1),
ends AS (SELECT count(*) AS n, {of("min({m}) AS low{i}, max({m}) AS high{i}")} FROM g),
s AS MATERIALIZED (SELECT g.*, [{of("CAST({m} - low{i} AS DOUBLE) / CASE WHEN high{i} = low{i} THEN 1.0 ELSE CAST(high{i} - low{i} AS DOUBLE) END")}] AS c FROM g, ends),
picks AS ({picks}), firsts AS (SELECT * FROM picks QUALIFY row_number() OVER (PARTITION BY fixture ORDER BY o) = 1),
st AS (SELECT list(fixture ORDER BY o) AS keys, list(c ORDER BY o) AS ats, list(reason ORDER BY o) AS reasons, 0 AS n FROM firsts
  UNION ALL SELECT list_append(keys, fixture), list_append(ats, c), list_append(reasons, 'greedy_shape_diversity_' || lpad(CAST(n + 1 AS VARCHAR), 2, '0')), n + 1 FROM (
    SELECT st.*, s.fixture, s.c FROM st, s WHERE len(keys) < 16 AND NOT list_contains(keys, s.fixture)
    ORDER BY list_min(list_transform(ats, lambda a: {of("(s.c[{i}] - a[{i}]) * (s.c[{i}] - a[{i}])", " + ")})) DESC, quantity DESC, lines DESC, abs(query_id), query_id DESC LIMIT 1))
SELECT CAST(unnest(range(0, len(keys))) AS INTEGER) AS place, unnest(keys) AS fixture, unnest(reasons) AS reason FROM st WHERE len(keys) = 16"""


def oracle_sql() -> dict[str, str]:
    return {
        "unit_digests": f"WITH {_UNITS} SELECT * FROM u",
        "whole_digest": f"""WITH {_UNITS}, b AS (SELECT substr(sha256(CAST(l_suppkey AS VARCHAR)), 1, 4) AS bucket, count(*) AS units, sum(records) AS records, sha256(string_agg(l_suppkey || chr(9) || sha256, chr(10) ORDER BY l_suppkey)) AS part FROM u GROUP BY 1)
SELECT CAST(sum(units) AS BIGINT) AS units, CAST(sum(records) AS BIGINT) AS records, sha256(string_agg(bucket || chr(9) || part, chr(10) ORDER BY bucket)) AS sha256 FROM b""",
        "diverse_fixtures": _diverse_sql(),
        "skip_timing": f"WITH {_SKIPS} SELECT *, CASE WHEN control_ms <> 0 THEN round(cold_ms / control_ms, 9) END AS cold_ratio, CASE WHEN control_ms <> 0 THEN round(hot_ms / control_ms, 9) END AS hot_ratio, cold_ms < control_ms AS cold_faster, hot_ms < control_ms AS hot_faster FROM t",
        "skip_checks": f"""WITH {_SKIPS} SELECT 'control_has_all_selected_queries' AS "check", missing = 0 AS passed FROM t UNION ALL SELECT 'selected_query_counts_match', skipped = selected FROM t UNION ALL SELECT 'fill_timing_recorded', fill_ms > 0 FROM t""",
        "target_checks": f"""WITH {_COST}, p AS (SELECT * FROM fit ORDER BY cost DESC, query_id LIMIT 20), r AS (SELECT count(*) AS n, coalesce(sum(raw), 0) AS raw, coalesce(sum(chain_inputs), 0) AS inputs, coalesce(sum(cost), 0) AS cost FROM p)
SELECT 'selected_query_count_positive' AS "check", n > 0 AS passed FROM r UNION ALL SELECT 'selected_has_raw_overlaps', raw > 0 FROM r UNION ALL SELECT 'selected_has_chain_inputs', inputs > 0 FROM r
UNION ALL SELECT 'selected_cost_exceeds_boundary', cost / 100000000 >= 5 FROM r UNION ALL SELECT 'hot_request_below_selected_cost', 1e12 < cost FROM r""",
        "distinct_keys": "SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1, 2",
        "order_checks": """SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous, NOT coalesce(bool_or(falls), false) AS sorted
FROM (SELECT *, l_partkey < lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS falls FROM lineitem) GROUP BY l_orderkey""",
        "broken_groups": """SELECT user_id, event_type, count(*) AS stretches FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
WHERE b IS NULL OR b <> event_type GROUP BY 1, 2 HAVING count(*) > 1""",
        "source_offsets": """SELECT l_suppkey, CAST(max(o) AS INTEGER) AS last_order, CAST(sum(x) AS BIGINT) AS offsets, CAST(max(x) AS BIGINT) AS last_offset FROM (
  SELECT l_suppkey, row_number() OVER w - 1 AS o, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)) GROUP BY 1""",
        "middle_rows": """SELECT o_orderpriority, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE r = n // 2 + 1""",
        "scaled_metric": """SELECT s_suppkey, CASE WHEN h = l THEN 0.0::DOUBLE ELSE round((s_acctbal - l) / (h - l), 6) END AS scaled
FROM (SELECT *, min(s_acctbal) OVER (PARTITION BY s_nationkey) AS l, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS h FROM supplier)""",
        "bag_digest": r"""SELECT count(*) AS records, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(9), CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), l_returnflag)), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM lineitem""",
        "bag_excess": "SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber <= 2 EXCEPT ALL SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber > 2",
        "places_in_ranges": """WITH r AS (SELECT row_number() OVER () AS n, l_orderkey, l_linenumber, l_suppkey AS id, l_partkey AS b, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem), p AS (SELECT l_suppkey AS id, l_partkey AS x FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, r.id, b AS "begin", e AS "end", count(p.x) AS inside FROM r LEFT JOIN p ON p.id = r.id AND p.x BETWEEN r.b AND r.e GROUP BY n, l_orderkey, l_linenumber, r.id, b, e""",
        "identity_states": """SELECT CASE WHEN lang = 'de' OR lang IS NULL OR text IS NULL THEN 'absent' WHEN lang <> 'en' OR upper(text) = text THEN 'same' ELSE 'differs' END AS state, count(*) AS n FROM documents GROUP BY 1""",
        "query_summary": f"WITH {_SUMMARY} SELECT * FROM s",
        "pack_support": f"""WITH {_COST} SELECT reason, count(*) AS n FROM (
  SELECT 'raw_overlap_count_zero' AS reason FROM c WHERE raw = 0 UNION ALL SELECT 'chain_input_count_zero' FROM c WHERE chain_inputs = 0 UNION ALL SELECT 'raw_overlap_count_exceeds_limit' FROM c WHERE raw > 5
  UNION ALL SELECT 'chain_input_count_exceeds_limit' FROM c WHERE chain_inputs > 3 UNION ALL SELECT 'duplicate_chain_input_read_begin' FROM c WHERE begins < chain_inputs) GROUP BY 1""",
        "target_plan": f"WITH {_COST} SELECT query_id, raw, chain_inputs, cost FROM fit ORDER BY cost DESC, query_id LIMIT 20",
        "target_gain": f"""WITH {_COST}, t AS (SELECT * FROM fit ORDER BY cost DESC, query_id LIMIT 20), a AS (SELECT count(*) AS all_queries, CAST(coalesce(sum(cost), 0) AS BIGINT) AS all_cost FROM c), b AS (SELECT count(*) AS chosen_queries, CAST(coalesce(sum(cost), 0) AS BIGINT) AS chosen_cost FROM t)
SELECT *, CASE WHEN all_cost <> 0 THEN round(chosen_cost / all_cost, 6) END AS share FROM a, b""",
        "pack_plan": f"""WITH {_COST}, one AS (SELECT query_id FROM fit WHERE filtered > 0 ORDER BY query_id LIMIT 1), two AS (SELECT query_id FROM fit WHERE raw > 1 AND query_id NOT IN (SELECT query_id FROM one) ORDER BY query_id LIMIT 1)
SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM one) THEN 0 WHEN query_id IN (SELECT query_id FROM two) THEN 1 ELSE 2 END AS turn, raw, filtered FROM fit ORDER BY turn, query_id LIMIT 6""",
        "shape_batches": f"WITH {_SUMMARY} SELECT chain_inputs, edge_live, count(*) AS fixtures, CAST(sum(raw) AS BIGINT) AS total_rows, min(query_id) AS first, max(query_id) AS last FROM s WHERE raw <= 6 GROUP BY 1, 2",
        "sampled_packs": f"""WITH {SEQUENCES_SQL}, ways AS (SELECT edge_seq_id AS id, seq FROM edges UNION ALL SELECT -edge_seq_id, {_RC.format('seq')} FROM edges),
iw AS (SELECT substr(seq, CAST(p + 1 AS BIGINT), 17) AS w FROM (SELECT seq, unnest(range(0, len(seq) - 16)) AS p FROM ways WHERE len(seq) >= 17)),
idx AS (SELECT least(w, {_RC.format('w')}) AS lk, count(*) AS rows FROM iw GROUP BY 1),
cuts AS (SELECT v.l || '/' || edge_seq_id AS sample, substr(seq, CAST(v.o + 1 AS BIGINT), CAST(coalesce(v.n, len(seq) - v.o) AS BIGINT)) AS seq FROM edges, (VALUES ('head', 0, 64), ('middle', 20, 100), ('rest', 10, NULL)) v(l, o, n)
  WHERE coalesce(v.n, len(seq) - v.o) >= 17 AND v.o + coalesce(v.n, len(seq) - v.o) <= len(seq)),
sw AS (SELECT sample, substr(seq, CAST(p + 1 AS BIGINT), 17) AS w FROM (SELECT sample, seq, unnest(range(0, len(seq) - 16)) AS p FROM cuts)),
u AS (SELECT sample, least(w, {_RC.format('w')}) AS lk, count(*) AS windows FROM sw GROUP BY 1, 2)
SELECT sample, CAST(sum(windows) AS BIGINT) AS windows, count(*) AS lookup_kmers, CAST(coalesce(sum(rows), 0) AS BIGINT) AS index_rows, count(*) FILTER (WHERE rows > 8) AS repetitive, CAST(sum(windows) * coalesce(sum(rows), 0) AS BIGINT) AS estimated_pairs
FROM u LEFT JOIN idx USING (lk) GROUP BY sample""",
        "warm_requests": "SELECT event_type, count(*) FILTER (WHERE r > 1) AS warm, count(*) FILTER (WHERE r = 1) AS cold FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) GROUP BY 1",
        "timing_stats": """WITH t AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS ms FROM events), s AS (SELECT event_type, count(*) AS runs, CAST(sum(ms) AS BIGINT) AS total, min(ms) AS least, sum(ms) / count(ms) AS mean, max(ms) AS most FROM t GROUP BY 1),
c AS (SELECT total AS ct, mean AS cm FROM s WHERE event_type = 'view') SELECT event_type, runs, total, least, round(mean, 6) AS mean, most, total - ct AS difference, CASE WHEN mean <> 0 THEN round(cm / mean, 6) END AS speedup FROM s, c""",
        "run_diff": """SELECT CASE WHEN a IS NULL THEN 'missing_left' WHEN b IS NULL THEN 'missing_right' WHEN a = b THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n
FROM (SELECT o_orderkey AS p, o_custkey AS a FROM orders WHERE o_orderstatus <> 'P') FULL JOIN (SELECT o_orderkey AS p, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS b FROM orders WHERE o_orderstatus <> 'F') USING (p) GROUP BY 1""",
        "node_labels": """WITH e AS (SELECT CAST(item_id + 1 AS VARCHAR) AS edge, CAST(item_id AS INTEGER) AS a, CAST(item_id + 1 AS INTEGER) AS b FROM benchmark),
n AS (SELECT node, coalesce(list(edge ORDER BY edge) FILTER (WHERE inward), []) AS i, coalesce(list(edge ORDER BY edge) FILTER (WHERE NOT inward), []) AS o FROM (SELECT a AS node, false AS inward, edge FROM e UNION ALL SELECT b, true, edge FROM e) GROUP BY node)
SELECT node, 'N' || lpad(CAST(row_number() OVER (ORDER BY i, o) - 1 AS VARCHAR), CAST(greatest(4, len(CAST(row_number() OVER (ORDER BY i, o) - 1 AS VARCHAR))) AS INTEGER), '0') AS label
FROM n WHERE (SELECT max(c) FROM (SELECT count(*) AS c FROM n GROUP BY i, o)) = 1""",
        "log_spans": """SELECT user_id AS run, count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS stages,
  CAST(epoch(date_trunc('second', max(CASE WHEN event_type = 'click' THEN ts END))) - epoch(date_trunc('second', max(CASE WHEN event_type = 'view' THEN ts END))) AS BIGINT) AS seconds FROM events GROUP BY 1""",
        "complement_chains": """WITH a AS (SELECT l_orderkey AS read_id, 0 AS chain_id, l_linenumber - 1 AS segment_id, l_linenumber AS read_begin, l_linenumber + CAST(l_quantity AS INTEGER) AS read_end, 100 AS read_len,
  l_suppkey AS edge_id, l_suppkey AS edge_seq_id, 3 AS edge_begin, CAST(l_quantity AS INTEGER) AS edge_end, 60 AS edge_len FROM lineitem)
SELECT * FROM a UNION ALL SELECT -read_id, chain_id, max(segment_id) OVER (PARTITION BY read_id) - segment_id, 99 - read_end, 99 - read_begin, 100, -edge_id, -edge_seq_id, 59 - edge_end, 59 - edge_begin, 60 FROM a""",
        "connectable": """WITH a AS (SELECT l_orderkey AS r, l_linenumber AS c, l_linenumber * 40 AS b, l_linenumber * 40 + CAST(l_quantity AS INTEGER) AS e, l_partkey % 3 AS ln, (l_partkey + 1) % 3 AS rn, l_suppkey % 50 AS eb FROM lineitem)
SELECT x.r AS read_id, count(*) AS pairs, CAST(sum(x.c) AS BIGINT) AS before, CAST(sum(y.c) AS BIGINT) AS after FROM a x JOIN a y ON x.r = y.r AND x.rn = y.ln AND x.c <> y.c
WHERE y.b - x.e > -10 AND y.b - x.e < 80 AND 40 + y.eb < 80 AND y.eb < 80 GROUP BY 1""",
    }
