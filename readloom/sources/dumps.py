"""Readers of headed dumps, packs of query folders, ledgers, graph dumps and logs; writers of text numbers and binaries."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.dna import query_group
from ..operators.ranking import ranked
from .artifacts import HEADER, MAGIC, RECORD
from .ordered import read_headed  # noqa: F401
from .records import SCHEMAS

# The columns of the boundary dump, and what its three kinds of rows are called.
BOUNDARY = (
    "record_type string, query_id long, order int, raw_overlap_count int, chain_input_count int, read_id long, read_begin int, read_end int, read_len int, edge_seq_id long, edge_begin int, edge_end int, "
    "edge_len int, edge_id long, score int, seq_divergence double, passes_chain_input_filter int, quick_overlap_wall_ms double, input_filter_sort_wall_ms double, cpu_chain_dp_wall_ms double, cpu_divergence_filter_wall_ms double"
)
KINDS = ("query_summary", "raw_overlap", "chain_input")


def split_boundary(rows: DataFrame) -> dict[str, DataFrame]:
    """The three kinds of rows of a boundary dump; any other kind is an error when it is read."""
    kind = F.when(F.col("record_type").isin(*KINDS), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of row: "), "record_type")))
    checked = rows.withColumn("record_type", kind)
    return {k: checked.filter(F.col("record_type") == k) for k in KINDS}


def folder_id(path: Column) -> Column:
    """The query id in a path with a folder query_<id> or query_neg<id>; null without one."""
    digits = F.regexp_extract(path, r"query_(?:neg)?(\d+)", 1)
    return F.when(digits != "", F.when(path.rlike(r"query_neg\d"), -digits.cast("long")).otherwise(digits.cast("long")))


def in_group(path: Column, query_id: Column) -> Column:
    """Whether a query belongs in the folder queries_<group>_of_<groups> of a path; null without one."""
    part = lambda i: F.nullif(F.regexp_extract(path, r"queries_(\d+)_of_([1-9]\d*)", i), F.lit("")).cast("int")
    return query_group(query_id, part(2)) == part(1)


def read_pack(spark: SparkSession, folder: str, file: str, schema: str, optional: bool = False) -> DataFrame:
    """The rows of ``file`` in all query folders of a pack, with pack_query, the id in the folder's name.

    In the folder of a group of queries it is the row's own query_id, or null if that belongs to another group. If no folder
    has the file, that is an error, unless it is optional; then there are no rows.
    """
    try:
        rows = spark.read.csv(f"{folder}/query_*/{file}", sep="\t", schema=SCHEMAS[schema], mode="FAILFAST")
    except AnalysisException as e:
        if not optional or e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMAS[schema])
    path = F.input_file_name()
    grouped = F.when(in_group(path, F.col("query_id")), F.col("query_id")) if "query_id" in rows.columns else F.lit(None).cast("long")
    return rows.withColumn("pack_query", F.coalesce(folder_id(path), grouped))


# The files that every query folder of a source pack has.
PACK_FILES = ("query.tsv", "query-minimizers.tsv", "index-buckets.tsv", "edge-sequences.tsv", "raw-overlaps.tsv", "oracle.chain-input.tsv", "missing-semantics.json")


def pack_files(spark: SparkSession, folder: str) -> DataFrame:
    """(pack_query, file, sha256) of all files in the query folders of a pack."""
    raw = spark.read.format("binaryFile").load(f"{folder}/query_*/*")
    return raw.select(folder_id(F.col("path")).alias("pack_query"), F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def missing_pack_files(files: DataFrame) -> DataFrame:
    """(pack_query, missing): query folders that lack one of the required files."""
    needed = F.array(*map(F.lit, PACK_FILES))
    return files.groupBy("pack_query").agg(F.array_sort(F.array_except(needed, F.collect_set("file"))).alias("missing")).filter("size(missing) > 0")


def pack_digests(files: DataFrame) -> DataFrame:
    """(pack_query, digest): the digest of the digests of a query's files, by name."""
    named = F.array_sort(F.collect_list(F.concat_ws("=", "file", "sha256")))
    return files.groupBy("pack_query").agg(F.sha2(F.array_join(named, "\n"), 256).alias("digest"))


def read_manifest(spark: SparkSession, path: str, schema: str, named: str) -> DataFrame:
    """JSON manifests of ``schema`` (with a field schema); one of another name ends the job when it is read."""
    raw = spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")
    wrong = F.raise_error(F.concat(F.lit(f"not a manifest of {named}: "), F.coalesce("schema", F.lit("none"))))
    return raw.withColumn("schema", F.when(F.col("schema") == named, F.col("schema")).otherwise(wrong))


def pack_count_faults(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(pack_query, stated, found) where the manifest (pack_query, stated) and the rows disagree."""
    found = rows.groupBy("pack_query").agg(F.count(F.lit(1)).alias("found"))
    return manifest.join(found, "pack_query", "full").fillna(0, ["stated", "found"]).filter("stated != found")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad JSON ends the job, rows without query_id are left out."""
    return spark.read.json(path, schema=schema, mode="FAILFAST").filter("query_id is not null")


def validated_ids(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, passed) of the fixtures in validation documents, ids from the fixtures' names."""
    raw = spark.read.json(path, schema="fixtures array<struct<name: string, status: string>>", multiLine=True, mode="FAILFAST")
    rows = raw.select(F.explode("fixtures").alias("f")).select(folder_id(F.col("f.name")).alias("query_id"), (F.col("f.status") == "match").alias("passed"))
    return rows.filter("query_id is not null")


def fixture_order(paths: DataFrame) -> DataFrame:
    """Paths of query folders with their query_id, in numerical order."""
    return paths.withColumn("query_id", folder_id(F.col("path"))).filter("query_id is not null").orderBy("query_id", "path")


def graph_records(lines: DataFrame) -> DataFrame:
    """(edge_id, start_node, end_node, sequences) of a graph dump's lines (dump, line_no, line).

    A line Edge starts a record; lines Sequence right after belong to it; any other line ends it.
    """
    words = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.filter("trim(line) != ''").withColumn("w", words)
    kind = F.when((F.get("w", F.lit(0)) == "Edge") & (F.size("w") >= 9), "edge").when(F.get("w", F.lit(0)) == "Sequence", "sequence").otherwise("other")
    so_far = Window.partitionBy("dump").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kind", kind).withColumn("block", F.count_if(F.col("kind") != "sequence").over(so_far))
    own = Window.partitionBy("dump", "block").orderBy("line_no")
    rows = rows.withColumn("head", F.first("kind").over(own)).filter("head = 'edge'")
    g = rows.groupBy("dump", "block").agg(F.min_by("w", "line_no").alias("w"), F.count_if(F.col("kind") == "sequence").alias("sequences"))
    return g.select("dump", F.col("w")[1].alias("edge_id"), F.col("w")[2].alias("start_node"), F.col("w")[3].alias("end_node"), "sequences")


def node_labels(records: DataFrame) -> DataFrame:
    """(node, label) of a graph (edge_id, start_node, end_node): N and the rank of the node's edges, in and out.

    No rows if two nodes have the same edges: labels would hide which is which.
    """
    ends = records.select(F.col("start_node").alias("node"), F.lit(0).alias("inward"), "edge_id").unionByName(records.select(F.col("end_node").alias("node"), F.lit(1).alias("inward"), "edge_id"))
    of = lambda way: F.sort_array(F.collect_list(F.when(F.col("inward") == way, F.col("edge_id").cast("string"))))
    nodes = ends.groupBy("node").agg(F.struct(of(1).alias("i"), of(0).alias("o")).alias("signature"))
    same = nodes.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1)).alias("most")).filter("most = 1")
    rank = F.col("rank").cast("string")
    label = F.concat(F.lit("N"), F.lpad(rank, F.greatest(F.lit(4), F.length(rank)), "0"))
    return ranked(nodes, ["signature"], "rank", 0).select("node", label.alias("label")).join(F.broadcast(same), how="left_semi")  # same is one row or none


def log_events(lines: DataFrame) -> DataFrame:
    """(run, at, event, stage) of log lines (run, line): stage, start or end of read alignment, others left out."""
    at = F.to_timestamp(F.nullif(F.regexp_extract("line", r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\]", 1), F.lit("")))
    event = F.when(F.contains(F.col("line"), F.lit(">>>STAGE:")), "stage").when(F.contains(F.col("line"), F.lit("Aligning reads to the graph")), "start").when(F.contains(F.col("line"), F.lit("Aligned read sequence:")), "end")
    rows = lines.select("run", at.alias("at"), event.alias("event"), F.nullif(F.trim(F.regexp_extract("line", r">>>STAGE:\s*(\S*)", 1)), F.lit("")).alias("stage"))
    return rows.filter("at is not null and event is not null")


def log_spans(events: DataFrame) -> DataFrame:
    """By run: stages, and seconds from the last start to the last end of read alignment (null if one is missing)."""
    last = lambda kind: F.max(F.when(F.col("event") == kind, F.unix_timestamp("at")))
    return events.groupBy("run").agg(F.count_if(F.col("event") == "stage").alias("stages"), (last("end") - last("start")).alias("seconds"))


@F.pandas_udf(StringType())
def nine_digits(values: pd.Series) -> pd.Series:
    """A number as text of nine significant digits; 0 for both zeros. For text files only."""
    return values.map(lambda v: None if pd.isna(v) else "0" if v == 0 else f"{v:.9g}")


def write_payloads(alignments: DataFrame, folder: str) -> DataFrame:
    """(query_id, file, records): the rows of each query as one binary payload below ``folder``, a shared path.

    A query's rows must fit in memory, as its payload has a count in front. Files appear whole, under their name.
    """
    from pyarrow import fs

    def write(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["chain_id", "segment_id"])
        body, head = np.zeros(len(g), RECORD), np.zeros(1, HEADER)
        for n in RECORD.names:
            body[n] = g[n].to_numpy()
        head["magic"], head["header_bytes"], head["record_bytes"], head["fixtures"], head["records"], head["inputs"], head["mode"] = MAGIC, HEADER.itemsize, RECORD.itemsize, 1, len(g), len(g), 1
        query = int(g["query_id"].iloc[0])
        file = f"{folder}/query_{query}.bin".replace("query_-", "query_neg")
        where, path = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
        part = f"{path}.{uuid.uuid4().hex}"  # a task that runs twice never leaves half a file under the name
        with where.open_output_stream(part) as out:
            out.write(head.tobytes() + body.tobytes())
        where.move(part, path)
        return pd.DataFrame({"query_id": [query], "file": [file], "records": [len(g)]})

    return alignments.select(*RECORD.names).groupBy("query_id").applyInPandas(write, "query_id long, file string, records long")
