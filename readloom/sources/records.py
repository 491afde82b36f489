"""Strict readers and canonical writers of tab-separated records, by named schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import internal_id
from .ordered import first_lines, numbered_lines

# The fields of each record contract, in file order.
SCHEMAS = {
    "query-kmer": "query_id long, query_pos long, query_kmer long, lookup_kmer long",
    "read": "read_id long, seq string",
    "index": "lookup_kmer long, target_id long, target_pos long, target_strand string",
    "query-window": "query_id long, query_pos long, sequence string",
    "index-window": "target_id long, target_pos long, target_strand string, sequence string",
    "repetitive-kmer": "lookup_kmer long",
    "repetitive-window": "sequence string",
    "full-query-hit": "query_id long, source_order long, query_pos long, query_kmer_repr long, standard_kmer_repr long, standard_revcomp int, is_repetitive int, kmer_freq long, target_edge_seq_id long, target_pos long",
    "query-minimizer": "query_id long, query_pos long, query_kmer_repr long, standard_kmer_repr long, standard_revcomp int, is_repetitive int, kmer_freq long",
    "index-bucket": "query_id long, query_pos long, standard_kmer_repr long, target_edge_seq_id long, target_pos long",
    "edge-sequence": "edge_seq_id long, edge_seq_len int, sequence string",
    "candidate-record-v1": "query_id long, query_pos long, kmer long, target_id long, target_pos long, target_strand string",
    "overlap-range-v1": "cur_id long, cur_begin int, cur_end int, cur_len int, ext_id long, ext_begin int, ext_end int, ext_len int, score long, seq_divergence float",
    "target": "target_id long, target_len int",
    "edge-overlap": "candidate_id long, read_id long, read_begin int, read_end int, read_len int, edge_id long, edge_left_node int, edge_right_node int, edge_seq_id long, edge_begin int, edge_end int, edge_len int, score int, seq_divergence double",
    "chain-divergence": "chain_id int, divergence double, accepted int",
    "read-alignment-v1": "chain_id int, segment_id int, read_id long, read_begin int, read_end int, read_len int, edge_id long, edge_seq_id long, edge_begin int, edge_end int, edge_len int, score int, seq_divergence double",
}


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headerless record file; a row of the wrong shape ends the job when it is read."""
    return spark.read.csv(path, sep="\t", schema=SCHEMAS[schema], mode="FAILFAST", header=False)


RULES = {
    "read": {"id": "read_id = 0", "bases": "seq not rlike '^[ACGTacgt]+$'"},
    "query-window": {"id": "query_id = 0", "position": "query_pos < 0", "bases": "sequence not rlike '^[ACGTacgt]+$'"},
    "index": {"id": "target_id = 0", "position": "target_pos < 0", "strand": "target_strand not in ('+', '-')"},
    "index-window": {"id": "target_id = 0", "position": "target_pos < 0", "strand": "target_strand not in ('+', '-')", "bases": "sequence not rlike '^[ACGTacgt]+$'"},
    "repetitive-window": {"bases": "sequence not rlike '^[ACGTacgt]+$'"},
    "full-query-hit": {"id": "query_id = 0 or target_edge_seq_id = 0", "position": "query_pos < 0 or target_pos < 0", "not-replayable": "is_repetitive != 0 or kmer_freq = 0"},
    "edge-sequence": {"id": "edge_seq_id = 0", "length": "edge_seq_len != length(sequence)"},
    "chain-divergence": {"id": "chain_id < 0", "divergence": "isnan(divergence) or divergence < 0", "accepted": "accepted not in (0, 1)"},
    "candidate-record-v1": {"id": "query_id = 0 or target_id = 0", "position": "query_pos < 0 or target_pos < 0", "strand": "target_strand not in ('+', '-')"},
    "overlap-range-v1": {"id": "cur_id = 0 or ext_id = 0", "cur": "not (0 <= cur_begin and cur_begin <= cur_end and cur_end < cur_len)", "ext": "not (0 <= ext_begin and ext_begin <= ext_end and ext_end < ext_len)", "divergence": "isnan(seq_divergence) or seq_divergence < 0"},
    "read-alignment-v1": {"id": "read_id = 0 or edge_seq_id = 0", "read": "not (0 <= read_begin and read_begin <= read_end and read_end < read_len)", "edge": "not (0 <= edge_begin and edge_begin <= edge_end and edge_end < edge_len)"},
}


def first_broken(rules: dict[str, str]) -> Column:
    """The name of the first rule (a SQL condition) that holds or is null; null if none."""
    return F.coalesce(*[F.when(F.expr(f"coalesce({rule}, true)"), F.lit(name)) for name, rule in rules.items()], F.lit(None).cast("string"))


def violations(df: DataFrame, schema: str) -> DataFrame:
    """Rows that break a record's invariants, with the name of the first one broken."""
    return df.withColumn("broken", first_broken(RULES[schema])).filter("broken is not null")


def _parsed(spark: SparkSession, path: str, schema: str, k: int | None) -> DataFrame:
    """(line, row, fault): the lines of record files, split at line feeds alone, and what is wrong with each.

    Whole numbers have no plus sign and no zero in front; k: the least length of reads and the length of windows.
    """
    fields = [f.split() for f in SCHEMAS[schema].split(", ")]
    parts = F.split("line", "\t", -1)
    text = lambda i: F.get(parts, F.lit(i))
    faults = [F.when(F.contains("line", F.lit("\r")), "line-end"), F.when(F.size(parts) != len(fields), "fields")]
    for i, (_, kind) in enumerate(fields):
        if kind in ("int", "long"):
            faults.append(F.when(~text(i).rlike(r"^(0|-?[1-9]\d*)$") | text(i).try_cast(kind).isNull(), "number"))
        elif kind in ("float", "double"):
            faults.append(F.when(~text(i).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number"))
    row = F.struct(*[text(i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)])
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line")).withColumn("row", row)
    rules = {name: rule for name, rule in RULES.get(schema, {}).items()}
    if k is not None:
        column = next(n for n, kind in fields if n in ("seq", "sequence"))
        rules["length"] = f"length({column}) {'<' if column == 'seq' else '!='} {k}"
    checked = lines.select("line", "row", "row.*").withColumn("fault", F.coalesce(*faults, first_broken(rules) if rules else F.lit(None).cast("string")))
    return checked.select("line", "row", "fault")


def record_faults(spark: SparkSession, path: str, schema: str, k: int | None = None) -> DataFrame:
    """(line, fault) of the lines that a strict reader would not take."""
    return _parsed(spark, path, schema, k).filter("fault is not null").select("line", "fault")


def read_strict(spark: SparkSession, path: str, schema: str, k: int | None = None, may_be_empty: bool = False) -> DataFrame:
    """The rows of record files; a line with a fault ends the job when it is read, an empty file does so at once."""
    rows = _parsed(spark, path, schema, k)
    if not may_be_empty and rows.isEmpty():
        raise ValueError(f"{path}: no records")
    stop = F.raise_error(F.concat(F.lit(f"{schema}: "), F.col("fault"), F.lit(" in line "), F.col("line")))
    return rows.select(F.when(F.col("fault").isNull(), F.col("row")).otherwise(stop).alias("row")).select("row.*")


def read_repetitive(spark: SparkSession, path: str | None, schema: str = "repetitive-kmer", k: int | None = None) -> DataFrame:
    """The distinct keys of a repetitive set; without a path, none."""
    return spark.createDataFrame([], SCHEMAS[schema]) if path is None else read_strict(spark, path, schema, k, may_be_empty=True).distinct()


def _fields(schema: str, line: Column) -> list[Column]:
    parts = F.split(line, "\t", -1)
    return [F.get(parts, F.lit(i)).cast(f.split()[1]).alias(f.split()[0]) for i, f in enumerate(SCHEMAS[schema].split(", "))]


def read_in_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of record files with line_no, their line's number in its file; files are read in splits."""
    return numbered_lines(spark, path).select(*_fields(schema, F.col("line")), "line_no")


def read_sample(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The first ``n`` records of one file, in its order; reading stops after them."""
    return first_lines(spark, path, n).select(*_fields(schema, F.col("line")))


def read_chain_divergence(spark: SparkSession, path: str) -> DataFrame:
    """Chain divergences in strict form; chain ids that are not 0, 1, 2 and so on are an error at once."""
    rows = read_strict(spark, path, "chain-divergence", may_be_empty=True)
    n, distinct, low, high = rows.agg(F.count(F.lit(1)), F.count_distinct("chain_id"), F.min("chain_id"), F.max("chain_id")).first()
    if n and (distinct != n or low != 0 or high != n - 1):
        raise ValueError(f"{path}: chain ids are not contiguous")
    return rows


def full_query_hits(rows: DataFrame) -> DataFrame:
    """Hits of a full-query-hit source, less the trivial self hit, by query in the order of match (match_order, from 0).

    A repetitive hit, or one of a k-mer that the index lacks, ends the job.
    """
    bad = (F.col("is_repetitive") != 0) | (F.col("kmer_freq") == 0)
    checked = rows.withColumn("target_pos", F.when(bad, F.raise_error(F.concat(F.lit("not replayable: hit of query "), F.col("query_id").cast("string"))).cast("long")).otherwise(F.col("target_pos")))
    return match_order(checked.filter(~((F.col("query_id") == F.col("target_edge_seq_id")) & (F.col("query_pos") == F.col("target_pos")))), "source_order")


def bucket_hits(rows: DataFrame, order: str = "line_no") -> DataFrame:
    """The same from index buckets, whose order is that of their lines."""
    return match_order(rows.filter(~((F.col("query_id") == F.col("target_edge_seq_id")) & (F.col("query_pos") == F.col("target_pos")))), order)


def match_order(rows: DataFrame, order: str) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(internal_id(F.col("target_edge_seq_id")), "query_pos", order)
    return rows.withColumn("match_order", F.row_number().over(by) - 1)


def source_hits(full: DataFrame | None, buckets: DataFrame) -> tuple[str, DataFrame]:
    """Which source a query's hits come from, and the hits: full ones where they are there, else buckets."""
    return ("full-query-hits", full_query_hits(full)) if full is not None else ("minimizer-buckets", bucket_hits(buckets))


def require(df: DataFrame, schema: str) -> DataFrame:
    """``df``, or an error if any row breaks an invariant."""
    if bad := violations(df, schema).take(3):
        raise ValueError(f"{schema}: {bad}")
    return df


def write_canonical(df: DataFrame, path: str) -> None:
    """Rows in the order of all their fields, tab-separated, in one sorted run of files; floats with nine digits."""
    from .dumps import nine_digits

    real = {f.name for f in df.schema if f.dataType.typeName() in ("float", "double")}
    ordered = df.orderBy(*df.columns)
    ordered.select(*[nine_digits(F.col(c).cast("double")).alias(c) if c in real else F.col(c) for c in df.columns]).write.csv(path, sep="\t", header=False)
