"""Queries of the record engine over the test tables, and equal DuckDB SQL where SQL can express them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import candidates as C
from ..operators import chains
from ..operators.base_alignment import chain_divergence
from ..sources.scratch import materialize, scratch_path
from ..sources.tables import SEQUENCES_SQL, edges, reads, table
from . import alignment, diffs, gate_queries, gates, planners, record_queries
from .chain_sql import ALL_STEPS, BEST_STEPS, graph_steps

K, MOST = 17, 8
PARAMS = chains.ChainParams(k=K, min_overlap=50, check_overhang=False, only_max_ext=True)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return C.candidates(reads(spark, sf), edges(spark, sf), K, MOST)


def kmer_candidates(spark, sf):
    return _hits(spark, sf)


def kmer_frequency(spark, sf):
    return C.kmer_frequency(C.kmer_index(edges(spark, sf), K)).groupBy("kmer_freq").agg(F.count(F.lit(1)).alias("kmers"))


def group_spans(spark, sf):
    return alignment.spans(_hits(spark, sf), reads(spark, sf), edges(spark, sf), PARAMS)


def _overlaps(spark, sf, p: chains.ChainParams) -> DataFrame:
    return alignment.overlap_reads(reads(spark, sf), edges(spark, sf), MOST, p)


def overlaps(spark, sf):
    return _overlaps(spark, sf, PARAMS).withColumn("seq_divergence", F.round(F.col("seq_divergence").cast("double"), 5))


def all_overlaps(spark, sf):
    """Every primary overlap of a pair, not the best one alone, without those that hang."""
    p = replace(PARAMS, only_max_ext=False, check_overhang=True, max_overhang=400)
    return _overlaps(spark, sf, p).withColumn("seq_divergence", F.round(F.col("seq_divergence").cast("double"), 5))


def chain_inputs(spark, sf):
    return chains.chain_inputs(overlaps(spark, sf))


GRAPH = chains.GraphParams(min_overlap=50, max_separation=50)


def aligned_reads(spark, sf):
    """Read alignments from sequences alone: overlaps, chains along the graph, and their base-level divergence."""
    return alignment.align_overlaps(overlaps(spark, sf), reads(spark, sf), edges(spark, sf), GRAPH)


def chain_divergences(spark, sf):
    """Edits and bases of every chain before the gate on divergence, with the chains' two strands as one bag."""
    inputs = chains.chain_inputs(overlaps(spark, sf))
    found = materialize(chains.chain_read_alignments(alignment.bind_edges(inputs, edges(spark, sf)), GRAPH), "chains")
    return chain_divergence(found, alignment.of_ids(reads(spark, sf), found.select("read_id")), edges(spark, sf)).withColumn("divergence", F.round("divergence", 9))


def pack_alignments(spark, sf):
    """The same alignments by way of a source pack: written as folders of queries, read back, replayed and accepted."""
    folder = scratch_path(spark, "source-pack")
    alignment.source_pack(reads(spark, sf), edges(spark, sf), MOST, K, folder)
    found = alignment.align_pack(spark, folder, reads(spark, sf), edges(spark, sf), PARAMS, GRAPH)
    return found.withColumn("seq_divergence", F.round("seq_divergence", 5))


def read_index_extraction(spark, sf):
    """By read: windows, those of k-mers that are repetitive in the edges, those the index has, and those it lacks."""
    freq = C.kmer_frequency(C.kmer_index(edges(spark, sf), K))
    met = C.lookup_windows(reads(spark, sf), K).join(C.unless_large(freq), "lookup_kmer", "left")
    return met.groupBy("read_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("kmer_freq") > MOST).alias("filtered"), F.count_if(F.col("kmer_freq") <= MOST).alias("indexed"), F.count_if(F.col("kmer_freq").isNull()).alias("absent"))


def pair_count(spark, sf):
    li = table(spark, sf, "lineitem")
    return C.pair_count(li.select(F.col("l_partkey").alias("key")), li.select(F.col("l_suppkey").alias("key")), "key")


def minimizer_counts(spark, sf):
    return C.minimizers(edges(spark, sf).select(F.col("edge_seq_id").alias("read_id"), "seq"), K, 5).groupBy("read_id").agg(F.count(F.lit(1)).alias("minimizers"), F.sum("pos").alias("positions"))


def sequence_functions(spark, sf):
    """Every window of every edge, encoded, decoded, in standard form and back."""
    w = edges(spark, sf).filter(F.length("seq") >= K).select("edge_seq_id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - K)).alias("pos"))
    e = w.select("edge_seq_id", "pos", F.substring("seq", F.col("pos") + 1, F.lit(K)).alias("kmer"))
    return e.select("edge_seq_id", F.col("pos").cast("long").alias("pos"), dna.kmer_encode(F.col("kmer"), K).alias("code"), dna.kmer_decode(dna.kmer_encode(F.col("kmer"), K), K).alias("decoded"), dna.kmer_standard(F.col("kmer")).alias("standard"), dna.standard_is_reverse(F.col("kmer")).alias("is_reverse"), dna.internal_id(-F.col("edge_seq_id")).alias("internal"), dna.query_dir_name(-F.col("edge_seq_id")).alias("folder"))


def _ledger(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("place"), (F.col("event_type") == "purchase").alias("selected"), F.col("event_type").isin("view", "click", "purchase").alias("supported"), F.round(F.col("value") * 100).cast("long").alias("ms"))


def ledger_stats(spark, sf):
    return planners.ledger_stats(_ledger(spark, sf))


def selection_plan(spark, sf):
    labels = table(spark, sf, "labels")
    ids = labels.select(F.col("doc_id").alias("query_id"), "quality", "toxic")
    plan = planners.plan_selection(ledger_stats(spark, sf), ids.filter("quality = 1 and toxic = 0"), ids.filter("toxic = 1"))
    return plan.withColumn("rank", F.col("rank").cast("int"))


def ledger_accounting(spark, sf):
    rows = planners.accounting(table(spark, sf, "events").select("user_id", "event_type"), "user_id", "event_type")
    return rows.withColumns({"user_id": F.coalesce("user_id", F.lit(-1)), "event_type": F.coalesce("event_type", F.lit("all"))})


def divergence_windows(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("begin"), F.col("l_quantity").cast("long").alias("length"), F.col("l_orderkey").alias("value"))
    return planners.longest_by_window(rows, 100)


def _sides(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return li.filter("l_linenumber <= 3"), li.filter("l_linenumber >= 2")


def canonical_diff(spark, sf):
    return diffs.canonical_diff(*_sides(spark, sf))


def row_key_diff(spark, sf):
    return diffs.row_key_diff(*_sides(spark, sf), ["l_orderkey", "l_linenumber"])


def validation_ledger(spark, sf):
    """Conditional counts by query with the contiguity of their numbering."""
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_returnflag") != "R").alias("kept"), ((F.max("l_linenumber") == F.count(F.lit(1))) & (F.count_distinct("l_linenumber") == F.count(F.lit(1)))).alias("contiguous"))


def shape_groups(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def reason_counts(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_linenumber", "l_returnflag")
    return gates.reason_counts(gates.with_reasons(li, {"quantity": "l_quantity > 45", "number": "l_linenumber > 4", "returned": "l_returnflag = 'R'"}))


def ownership(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    chosen = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = gates.ownership(li, li.filter("l_returnflag = 'R'"), chosen, ["l_orderkey", "l_linenumber"], "l_orderkey")
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def edge_states(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).alias("edge_id"))
    live = table(spark, sf, "region").select(F.col("r_regionkey").alias("edge_id"))
    return gates.edge_state(li, live).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def field_differences(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").dropDuplicates(["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    other = li.withColumns({"l_suppkey": F.col("l_suppkey") + F.when(F.col("l_linenumber") == 3, 1).otherwise(0), "l_partkey": F.col("l_partkey") + F.when(F.col("l_linenumber") == 2, 5).otherwise(1)})
    return gates.field_differences(li, other, ["l_orderkey", "l_linenumber"], ["l_suppkey", "l_partkey"], 1)


def queries() -> dict:
    found = [kmer_candidates, kmer_frequency, group_spans, overlaps, all_overlaps, chain_inputs, aligned_reads, chain_divergences, pack_alignments, read_index_extraction, pair_count, minimizer_counts, sequence_functions, ledger_stats, selection_plan, ledger_accounting, divergence_windows, canonical_diff, row_key_diff, validation_ledger, shape_groups, reason_counts, ownership, edge_states, field_differences]
    return {f.__name__: f for f in found} | record_queries.queries() | gate_queries.queries()


_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_CODE = "CAST(list_sum(list_transform(range(0, 17), lambda i: CAST(strpos('ACGT', substr({0}, CAST(i + 1 AS BIGINT), 1)) - 1 AS BIGINT) * CAST(4 ** (16 - i) AS BIGINT))) AS BIGINT)"
_INDEX = f"""{SEQUENCES_SQL}, ways AS (
  SELECT edge_seq_id AS id, seq FROM edges UNION ALL SELECT -edge_seq_id, {_RC.format('seq')} FROM edges
), iw AS (
  SELECT id, p AS pos, substr(seq, CAST(p + 1 AS BIGINT), 17) AS s FROM (SELECT id, seq, unnest(range(0, len(seq) - 16)) AS p FROM ways WHERE len(seq) >= 17)
), idx AS (
  SELECT id, pos, least(s, {_RC.format('s')}) AS lk, {_RC.format('s')} < s AS rev FROM iw
)"""
_HITS = f"""{_INDEX}, qw AS (
  SELECT id, p AS pos, substr(seq, CAST(p + 1 AS BIGINT), 17) AS s FROM (SELECT read_id AS id, seq, unnest(range(0, len(seq) - 16)) AS p FROM reads WHERE len(seq) >= 17)
), q AS (
  SELECT id, pos, s, least(s, {_RC.format('s')}) AS lk, {_RC.format('s')} < s AS rev FROM qw
), hits AS (
  SELECT q.id AS query_id, CAST(q.pos AS BIGINT) AS query_pos, q.s AS s, i.id AS target_id, CAST(i.pos AS BIGINT) AS target_pos,
         CASE WHEN i.id > 0 THEN '+' ELSE '-' END AS target_strand
  FROM q JOIN idx i ON q.lk = i.lk AND q.rev = i.rev
  WHERE q.lk NOT IN (SELECT lk FROM idx GROUP BY lk HAVING count(*) > 8) AND NOT (q.id = i.id AND q.pos = i.pos)
)"""

_CHAIN_TABLES = f"""{_HITS}, lens AS (SELECT read_id AS id, len(seq) AS n FROM reads), elens AS (SELECT edge_seq_id AS id, len(seq) AS n FROM edges),
lost AS (SELECT id, pos FROM q WHERE lk IN (SELECT lk FROM idx GROUP BY lk HAVING count(*) > 8))"""
_BEST = f"{_CHAIN_TABLES}, {BEST_STEPS}"
_ALL = f"{_CHAIN_TABLES}, {ALL_STEPS}"
# A chain's stretches from the sequences; the list of a read's overlaps is in the order of chain inputs, so k is one more
# than an input's place.
_ALIGNED = f"""{_BEST}, inputs AS (
  SELECT *, row_number() OVER (PARTITION BY cur_id ORDER BY cur_begin, ext_id, ext_begin, cur_end) - 1 AS cand FROM ov WHERE ext_len < 900 OR least(cur_end - cur_begin, ext_end - ext_begin) > 500
), e AS (
  SELECT cur_id AS read_id, cand, cur_begin AS b, cur_end AS z, cur_len AS rl, ext_id AS edge, CAST(CASE WHEN ext_id > 0 THEN n.item_id ELSE -n.item_id - 1 END AS INTEGER) AS ln, CAST(CASE WHEN ext_id > 0 THEN n.item_id + 1 ELSE -n.item_id END AS INTEGER) AS rn,
    ext_begin AS eb, ext_end AS ee, ext_len AS el, CAST(score AS INTEGER) AS sc, seq_divergence AS d FROM inputs JOIN benchmark n ON n.item_id + 1 = abs(ext_id)
), {graph_steps(GRAPH)}, segs AS (
  SELECT read_id, chain_id, unnest(path) AS k, unnest(range(0, len(path))) AS segment_id FROM chain
), stretches AS (
  SELECT s.*, e.*, substr(r.seq, e.b + 1, e.z - e.b + 1) AS a_seq, CASE WHEN e.edge > 0 THEN substr(g.seq, e.eb + 1, e.ee - e.eb + 1) ELSE {_RC.format('substr(g.seq, e.el - e.ee, e.ee - e.eb + 1)')} END AS b_seq
  FROM segs s JOIN e ON e.read_id = s.read_id AND e.cand = s.k - 1 JOIN reads r ON r.read_id = s.read_id JOIN edges g ON g.edge_seq_id = abs(e.edge)
), divs AS (
  SELECT read_id, chain_id, CAST(sum(levenshtein(a_seq, b_seq)) AS BIGINT) AS edits, CAST(sum(greatest(len(a_seq), len(b_seq))) AS BIGINT) AS bases FROM stretches GROUP BY 1, 2
), good AS (
  SELECT read_id, chain_id, row_number() OVER (PARTITION BY read_id ORDER BY chain_id) - 1 AS again FROM divs WHERE edits / bases < 0.25)"""
_ALIGNED_ROWS = "SELECT CAST(again AS INTEGER) AS chain_id, CAST(segment_id AS INTEGER) AS segment_id, read_id, b AS read_begin, z AS read_end, rl AS read_len, edge AS edge_id, edge AS edge_seq_id, eb AS edge_begin, ee AS edge_end, el AS edge_len, sc AS score, d AS seq_divergence FROM stretches JOIN good USING (read_id, chain_id)"
_STATS = """led AS (
  SELECT user_id AS query_id, event_id AS place, event_type = 'purchase' AS selected, event_type IN ('view', 'click', 'purchase') AS supported,
         CAST(round(value * 100) AS BIGINT) AS ms FROM events
), seen AS (
  SELECT *, sum(CAST(supported AS INTEGER)) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS seen FROM led
), stats AS (
  SELECT query_id, count(*) AS observations, CAST(sum(CAST(selected AS INTEGER)) AS BIGINT) AS selected, CAST(sum(CAST(supported AS INTEGER)) AS BIGINT) AS supported,
         min(place) AS first_place, max(place) AS last_place, CAST(sum(ms) AS BIGINT) AS total_ms,
         CAST(coalesce(sum(CASE WHEN seen > 1 THEN ms END), 0) AS BIGINT) AS later_ms, max(ms) AS max_ms
  FROM seen GROUP BY query_id
)"""


def oracle_sql() -> dict[str, str]:
    return record_queries.oracle_sql() | gate_queries.oracle_sql() | {
        "kmer_candidates": f"WITH {_HITS} SELECT query_id, query_pos, {_CODE.format('s')} AS kmer, target_id, target_pos, target_strand FROM hits",
        "kmer_frequency": f"WITH {_INDEX} SELECT kmer_freq, count(*) AS kmers FROM (SELECT lk, count(*) AS kmer_freq FROM idx GROUP BY lk) GROUP BY kmer_freq",
        "group_spans": f"""WITH {_HITS}, g AS (
  SELECT query_id, target_id, count(*) AS hits, count(DISTINCT CASE WHEN query_pos <> 0 THEN query_pos END) AS unique_positions,
         min(query_pos) AS min_cur, max(query_pos) AS max_cur, min(target_pos) AS min_ext, max(target_pos) AS max_ext FROM hits GROUP BY query_id, target_id)
SELECT g.*, CAST(len(r.seq) AS INTEGER) AS query_len, CAST(len(e.seq) AS INTEGER) AS target_len,
       unique_positions >= 0.01 * 50 AND max_cur - min_cur >= 50 AND max_ext - min_ext >= 50 AS survives
FROM g LEFT JOIN reads r ON r.read_id = g.query_id LEFT JOIN edges e ON e.edge_seq_id = abs(g.target_id)""",
        "overlaps": f"WITH RECURSIVE {_BEST} SELECT * FROM ov",
        "all_overlaps": f"WITH RECURSIVE {_ALL} SELECT * FROM ov",
        "chain_inputs": f"""WITH RECURSIVE {_BEST} SELECT *, CAST(row_number() OVER (PARTITION BY cur_id ORDER BY cur_begin, ext_id, ext_begin, cur_end) - 1 AS INTEGER) AS "order" FROM ov WHERE ext_len < 900 OR least(cur_end - cur_begin, ext_end - ext_begin) > 500""",
        "aligned_reads": f"WITH RECURSIVE {_ALIGNED} {_ALIGNED_ROWS}",
        "pack_alignments": f"WITH RECURSIVE {_ALIGNED} {_ALIGNED_ROWS}",
        "read_index_extraction": f"""WITH {_INDEX}, freq AS (SELECT lk, count(*) AS n FROM idx GROUP BY 1), qw AS (
  SELECT id, substr(seq, CAST(p + 1 AS BIGINT), 17) AS s FROM (SELECT read_id AS id, seq, unnest(range(0, len(seq) - 16)) AS p FROM reads WHERE len(seq) >= 17))
SELECT id AS read_id, count(*) AS windows, count(*) FILTER (WHERE n > 8) AS filtered, count(*) FILTER (WHERE n <= 8) AS indexed, count(*) FILTER (WHERE n IS NULL) AS absent FROM qw LEFT JOIN freq ON lk = least(s, {_RC.format('s')}) GROUP BY 1""",
        "chain_divergences": f"WITH RECURSIVE {_ALIGNED} SELECT read_id, CAST(chain_id AS INTEGER) AS chain_id, edits, bases, round(edits / bases, 9) AS divergence FROM divs",
        "pair_count": "SELECT CAST(coalesce(sum(a.n * b.m), 0) AS BIGINT) AS matches FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT l_suppkey AS k, count(*) AS m FROM lineitem GROUP BY 1) b ON a.k = b.k",
        "minimizer_counts": f"""WITH {SEQUENCES_SQL}, w AS (
  SELECT id, p AS pos, substr(seq, CAST(p + 1 AS BIGINT), 17) AS s FROM (SELECT edge_seq_id AS id, seq, unnest(range(0, len(seq) - 16)) AS p FROM edges WHERE len(seq) >= 17)
), t AS (SELECT id, pos, least(s, {_RC.format('s')}) AS kmer FROM w
), x AS (SELECT a.id, a.pos AS start, b.pos, b.kmer, row_number() OVER (PARTITION BY a.id, a.pos ORDER BY b.kmer, b.pos) AS r, count(*) OVER (PARTITION BY a.id, a.pos) AS n
  FROM t a JOIN t b ON a.id = b.id AND b.pos BETWEEN a.pos AND a.pos + 4)
SELECT id AS read_id, count(*) AS minimizers, CAST(sum(pos) AS BIGINT) AS positions FROM (SELECT DISTINCT id, pos, kmer FROM x WHERE r = 1 AND n = 5) GROUP BY id""",
        "sequence_functions": f"""WITH {SEQUENCES_SQL}, e AS (SELECT edge_seq_id, p AS pos, substr(seq, CAST(p + 1 AS BIGINT), 17) AS s FROM (SELECT edge_seq_id, seq, unnest(range(0, len(seq) - 16)) AS p FROM edges WHERE len(seq) >= 17))
SELECT edge_seq_id, CAST(pos AS BIGINT) AS pos, {_CODE.format('s')} AS code, s AS decoded, least(s, {_RC.format('s')}) AS standard, CAST({_RC.format('s')} < s AS INTEGER) AS is_reverse,
       2 * edge_seq_id - 1 AS internal, 'query_neg' || edge_seq_id AS folder FROM e""",
        "ledger_stats": f"WITH {_STATS} SELECT * FROM stats",
        "selection_plan": f"""WITH {_STATS}, r AS (
  SELECT s.*, CASE WHEN s.query_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'validation_failed'
    WHEN s.query_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) THEN 'missing_validation'
    WHEN supported < 2 THEN 'insufficient_supported_observations' END AS reason FROM stats s)
SELECT *, CAST(row_number() OVER (ORDER BY reason IS NOT NULL, later_ms DESC, supported DESC, first_place, abs(query_id), query_id) AS INTEGER) AS rank FROM r""",
        "ledger_accounting": "SELECT coalesce(user_id, -1) AS user_id, coalesce(event_type, 'all') AS event_type, CAST(grouping(user_id, event_type) AS BIGINT) AS level, count(*) AS n FROM events GROUP BY GROUPING SETS ((user_id), (event_type), (user_id, event_type))",
        "divergence_windows": """SELECT id, stretch, begin, length, value FROM (
  SELECT l_suppkey AS id, CAST(floor(l_partkey / 100.0) AS BIGINT) AS stretch, l_partkey AS begin, CAST(l_quantity AS BIGINT) AS length, l_orderkey AS value,
         row_number() OVER (PARTITION BY l_suppkey, floor(l_partkey / 100.0) ORDER BY l_quantity DESC, l_partkey, l_orderkey) AS r FROM lineitem) WHERE r = 1""",
        "canonical_diff": """WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linenumber >= 2),
m AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), x AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT (SELECT count(*) FROM a) AS left_records, (SELECT count(*) FROM b) AS right_records, m.n AS missing, x.n AS extra, CASE WHEN m.n = 0 AND x.n = 0 THEN 'match' ELSE 'mismatch' END AS status FROM m, x""",
        "row_key_diff": """WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber, 1 AS a FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_orderkey, l_linenumber, 1 AS b FROM lineitem WHERE l_linenumber >= 2)
SELECT CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' ELSE 'matched' END AS state, count(*) AS n FROM a FULL JOIN b USING (l_orderkey, l_linenumber) GROUP BY 1""",
        "validation_ledger": "SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_returnflag <> 'R') AS kept, max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1",
        "shape_groups": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1, 2",
        "reason_counts": """SELECT * FROM (SELECT 'quantity' AS reason, count(*) AS n FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 'number', count(*) FROM lineitem WHERE l_linenumber > 4
UNION ALL SELECT 'returned', count(*) FROM lineitem WHERE l_returnflag = 'R') WHERE n > 0""",
        "ownership": """SELECT CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'kept'
  WHEN (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R') THEN 'replaced' ELSE 'selected_missing' END AS decision, count(*) AS n FROM lineitem GROUP BY 1""",
        "edge_states": "SELECT CASE WHEN l_linenumber = 1 THEN 'none' WHEN l_linenumber - 1 IN (SELECT r_regionkey FROM region) THEN 'live' ELSE 'unresolved' END AS state, count(*) AS n FROM lineitem GROUP BY 1",
        "field_differences": """WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem), m AS (
  SELECT abs(a.l_suppkey - b.l_suppkey - CASE WHEN b.l_linenumber = 3 THEN 1 ELSE 0 END) AS s, abs(a.l_partkey - b.l_partkey - CASE WHEN b.l_linenumber = 2 THEN 5 ELSE 1 END) AS p
  FROM a JOIN a b USING (l_orderkey, l_linenumber))
SELECT 'l_suppkey' AS field, count(*) FILTER (WHERE s > 1) AS n FROM m UNION ALL SELECT 'l_partkey', count(*) FILTER (WHERE p > 1) FROM m""",
    }
