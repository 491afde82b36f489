"""Operator 4: chat formatting by tool-call linking, in DataFrame operations only.

Calls and results meet in a hash join on the call's identifier. A call can name a parent, the call whose result it
uses; the depth of every call below its root comes from pointer jumping (each round doubles the reach, so a chain of n
calls takes log2 n joins), and ``depth, turn, call_id`` is a topological order. Arguments are checked against the
schema of their tool as variants, and everything is written as canonical JSON: keys sorted, no white space.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: A forest of 2^48 calls in one chain would need more rounds.
ROUNDS = 48
CALL_COLUMNS = ("conv_id", "turn", "call_id", "tool", "arguments", "parent_id")


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth) of every call; depth is null on a cycle. calls: distinct call_id, and parent_id or null."""
    ids = calls.select(F.col("call_id").alias("up"))
    now = calls.select("call_id", F.col("parent_id").alias("up"))
    # A parent that is no call makes its child a root.
    now = materialize(now.join(ids, "up", "left_semi").select("call_id", "up", F.lit(1).cast("long").alias("depth")), "parents")
    roots = calls.join(now, "call_id", "left_anti").select("call_id", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("depth"))
    done = materialize(roots, "roots")
    rounds = 0
    limit = min(ROUNDS, 1 + max(1, now.count()).bit_length())
    while rounds < limit:
        step = now.unionByName(done).select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        new = materialize(now.join(step, "up").select("call_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")), "jump")
        ended = new.filter("up is null")
        done = done.unionByName(ended)
        now, rounds = new.filter("up is not null"), rounds + 1
        if now.isEmpty():
            break
    return done.select("call_id", "depth").unionByName(now.select("call_id", F.lit(None).cast("long").alias("depth")))


def ranked(rows: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Distinct ``rows`` with their rank and number n; and (call_id, rank) of the first row of every call_id."""
    own = [c for c in rows.columns if c not in ("call_id", "turn")]
    rank = F.struct("turn", F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(1), *reversed(own)).alias("h2"))
    rows = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.to_json(rank)).withColumn("key", rank), tag)
    heads = rows.filter("call_id is not null").groupBy("call_id").agg(F.min("key").alias("key"), F.sum("n").alias("all"))
    heads = materialize(heads.select("call_id", F.to_json("key").alias("rank"), "all"), f"{tag}-heads")
    return rows.drop("key"), heads.select("call_id", "rank", "all")


def others(rows: DataFrame, heads: DataFrame, error: str) -> DataFrame:
    """The rows of ``ranked`` that are not the first of their call_id, each as often as it is there, with an ``error``."""
    several = heads.filter("all > 1").select("call_id", F.col("rank").alias("first"))
    again = rows.join(several, "call_id").withColumn("n", F.col("n") - (F.col("rank") == F.col("first")).cast("long")).drop("first").withColumn("error", F.lit(error))
    lost = rows.filter("call_id is null").withColumn("error", F.lit("missing_id"))
    return again.unionByName(lost).filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("copy", "n", "rank")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result that is not the answer of a call.

    calls: conv_id, turn, call_id, tool, arguments (JSON), parent_id. results: call_id, turn, content. schemas: tool and
    fields (array of struct name, type, required; type: string, integer, number, boolean, array or object).
    Returns conv_id, turn, call_id, tool, depth, errors (array of strings, sorted) and message (canonical JSON).

    Of calls with one call_id the first by turn (then by a hash of the rest) counts, the others keep their own content
    and have the error duplicate_call; of its results the first by turn and then hash, the others have duplicate_result.
    Nulls and errors: a call or result without identifier (missing_id), a call of an unknown tool, whose arguments are
    no JSON object, lack a required field, hold a wrong type or an unknown field, without a result, before its parent's
    turn, of an unknown parent or on a cycle (depth null); a result without a call (orphan_result). Of schemas of one
    tool the first by its JSON text counts. Empty tables give no rows; other columns are not read; long texts count whole.
    """
    columns = list(CALL_COLUMNS)
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.col(c).cast("string").alias(c) for c in CALL_COLUMNS[2:]])
    results = results.select(F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), F.col("content").cast("string").alias("content"))
    calls, call_heads = ranked(calls, "calls")
    results, result_heads = ranked(results, "results")
    heads = calls.join(call_heads, ["call_id", "rank"]).select("call_id", F.struct(*[c for c in columns if c != "call_id"]).alias("head"))
    answers = results.join(result_heads, ["call_id", "rank"]).select("call_id", F.struct("turn", "content").alias("answer"))
    # Both sides are dealt by call_id already.
    met = materialize(heads.join(answers, "call_id", "full"), "linked")
    nodes = met.filter("head is not null").select("call_id", "head.parent_id", "head.turn")
    parents = nodes.select(F.col("call_id").alias("parent_id"), F.col("turn").alias("parent_turn"))
    facts = depths(nodes.select("call_id", "parent_id")).join(nodes.select("call_id", "parent_id").join(parents, "parent_id").select("call_id", "parent_turn"), "call_id", "left")

    linked = met.select("call_id", "head.*", "answer", F.col("head").isNull().alias("orphan")).join(facts, "call_id", "left")
    answer = "struct<turn:bigint,content:string>"
    lost = others(calls, call_heads, "duplicate_call").select(*columns, "error", F.lit(None).cast(answer).alias("answer"))
    none = [F.lit(None).cast("string").alias(c) for c in ("tool", "arguments", "parent_id")]
    unused = others(results, result_heads, "duplicate_result").select(F.lit(None).cast("long").alias("conv_id"), "turn", "call_id", *none, "error", F.struct("turn", "content").alias("answer"))
    plain = lost.unionByName(unused)

    checked = linked.join(schemas.groupBy(F.col("tool").cast("string").alias("tool")).agg(F.min_by("fields", F.to_json("fields")).alias("fields")), "tool", "left")
    value = F.try_parse_json("arguments")
    checked = checked.withColumn("parsed", value).withColumn("given", F.expr("case when schema_of_variant(parsed) like 'OBJECT%' then cast(parsed as map<string,variant>) end"))
    kinds = F.expr(
        """transform(map_entries(given), e -> struct(e.key as name, case
             when schema_of_variant(e.value) = 'STRING' then 'string' when schema_of_variant(e.value) = 'BIGINT' then 'integer'
             when schema_of_variant(e.value) = 'BOOLEAN' then 'boolean' when schema_of_variant(e.value) = 'VOID' then 'null'
             when schema_of_variant(e.value) like 'ARRAY%' then 'array' when schema_of_variant(e.value) like 'OBJECT%' then 'object'
             else 'number' end as kind))"""
    )
    checked = checked.withColumn("kinds", kinds)
    errors = F.expr(
        """array_sort(array_compact(concat(
             case when orphan then array('orphan_result') else array(
               case when fields is null then 'unknown_tool' end,
               case when given is null then 'invalid_arguments' end,
               case when answer is null then 'no_result' end,
               case when parent_id is not null and parent_turn is null then 'unknown_parent' end,
               case when parent_turn >= turn then 'before_parent' end,
               case when depth is null then 'cycle' end) end,
             case when fields is null or given is null then cast(array() as array<string>) else concat(
               transform(filter(fields, f -> f.required and not exists(kinds, k -> k.name = f.name)), f -> concat('missing:', f.name)),
               transform(filter(kinds, k -> not exists(fields, f -> f.name = k.name)), k -> concat('unknown:', k.name)),
               transform(filter(fields, f -> exists(kinds, k -> k.name = f.name and k.kind <> f.type and not (f.type = 'number' and k.kind = 'integer'))), f -> concat('type:', f.name))) end)))"""
    )
    full = checked.withColumn("errors", errors)
    out = full.select("conv_id", F.coalesce("turn", F.when(F.col("orphan"), F.col("answer.turn"))).alias("turn"), "call_id", "tool", F.when(~F.col("orphan"), F.col("depth")).alias("depth"), "errors", canonical_message(full).alias("message"))
    rest = plain.withColumn("parsed", F.try_parse_json("arguments")).withColumn("depth", F.lit(None).cast("long"))
    return out.unionByName(rest.select("conv_id", "turn", "call_id", "tool", "depth", F.array("error").alias("errors"), canonical_message(rest).alias("message")))


def canonical_message(df: DataFrame) -> F.Column:
    """{"arguments": .., "call_id": .., "depth": .., "result": .., "tool": ..} with sorted keys at every level.

    Variants keep the fields of an object sorted, so writing a parsed text out again gives its canonical form.
    Arguments that are no JSON are kept as a string.
    """
    texts = F.struct(F.col("call_id").alias("call_id"), F.col("depth").alias("depth"), F.col("answer.content").alias("result"), F.col("tool").alias("tool"))
    rest = F.to_json(texts, {"ignoreNullFields": "false"})
    raw = F.expr("substring(to_json(struct(arguments as x)), 6)")  # '"..."}' of {"x":"..."}
    arguments = F.coalesce(F.to_json("parsed"), F.when(F.col("arguments").isNotNull(), raw.substr(F.lit(1), F.length(raw) - 1)), F.lit("null"))
    return F.concat(F.lit('{"arguments":'), arguments, F.lit(","), rest.substr(F.lit(2), F.length(rest)))


#: The tool that the query's calls are of.
TURN_SCHEMA = "tool string, fields array<struct<name:string,type:string,required:boolean>>"


def turns_as_calls(chats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table of conversations holds no tool calls as such: every user turn is a call of ``reply`` with its text and
    turn as arguments, identified by conversation and turn, that uses the result of the user turn two before; the
    assistant turn after it is its result."""
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    asked = rows.filter("role = 'user' and conv_id is not null and turn is not null")
    arguments = F.to_json(F.struct(F.col("turn"), F.coalesce("text", F.lit("")).alias("text")))
    calls = asked.select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, name(F.col("turn") - 2)).alias("parent_id"))
    results = rows.filter("role = 'assistant' and conv_id is not null and turn is not null").select(name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    schemas = chats.sparkSession.createDataFrame([("reply", [("text", "string", True), ("turn", "integer", True)])], TURN_SCHEMA)
    return calls, results, schemas


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked, ordered and validated."""
    linked = link_tool_calls(*turns_as_calls(table(spark, sf_dir, "conversations")))
    return linked.withColumn("errors", F.array_join("errors", ","))


ORACLE = {
    "op4_tool_calls": """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id,
         CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END AS parent_id, coalesce(text, '') AS text
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
), results AS (
  SELECT conv_id || ':' || (turn - 1) AS call_id, turn, text AS content
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
), deep AS (
  SELECT call_id, CAST(0 AS BIGINT) AS depth FROM calls
  WHERE parent_id IS NULL OR parent_id NOT IN (SELECT call_id FROM calls)
  UNION ALL
  SELECT c.call_id, d.depth + 1 FROM calls c JOIN deep d ON c.parent_id = d.call_id
), linked AS (
  SELECT c.conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id,
         CASE WHEN c.call_id IS NOT NULL THEN 'reply' END AS tool, d.depth,
         CASE WHEN c.call_id IS NULL THEN 'orphan_result' ELSE concat_ws(',',
           CASE WHEN r.call_id IS NULL THEN 'no_result' END,
           CASE WHEN c.parent_id IS NOT NULL AND p.call_id IS NULL THEN 'unknown_parent' END) END AS errors,
         c.text, r.content, c.turn AS asked
  FROM calls c FULL JOIN results r ON c.call_id = r.call_id
  LEFT JOIN deep d ON d.call_id = c.call_id LEFT JOIN calls p ON p.call_id = c.parent_id
)
SELECT conv_id, turn, call_id, tool, depth, errors,
       '{"arguments":' || CASE WHEN asked IS NULL THEN 'null' ELSE '{"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || asked || '}' END
       || ',"call_id":' || CAST(to_json(call_id) AS VARCHAR) || ',"depth":' || coalesce(CAST(depth AS VARCHAR), 'null')
       || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"tool":' || coalesce(CAST(to_json(tool) AS VARCHAR), 'null') || '}' AS message
FROM linked
"""
}
