"""Two-bit k-mers, signed identifiers and inclusive ranges as column expressions (all of them stay in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_K = 31  # two bits a base in a signed long


def _k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be in 1..{MAX_K}")
    return k


def kmer_encode(seq: Column, k: int) -> Column:
    """A, C, G, T (either case) as base-4 digits, the first base highest."""
    _k(k)
    return F.conv(F.translate(F.upper(seq), "ACGT", "0123"), 4, 10).cast("bigint")


def kmer_decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), _k(k), "0"), "0123", "ACGT")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGT", "TGCA"))


def code_reverse_complement(code: Column, k: int) -> Column:
    """The reverse complement of an encoded k-mer."""
    return F.conv(F.reverse(F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), _k(k), "0"), "0123", "3210")), 4, 10).cast("bigint")


def kmer_standard(seq: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; text order is code order, as A < C < G < T."""
    return F.least(F.upper(seq), reverse_complement(seq))


def standard_is_reverse(seq: Column) -> Column:
    return (reverse_complement(seq) < F.upper(seq)).cast("int")


def internal_id(signed: Column) -> Column:
    """Signed ids (sign = strand) in the order of an index with both strands side by side."""
    return F.when(signed > 0, 2 * (signed - 1)).otherwise(2 * (-signed) - 1)


def strand(signed: Column) -> Column:
    return F.when(signed > 0, F.lit("+")).otherwise(F.lit("-"))


def overhang(cur_begin, cur_end, cur_len, ext_begin, ext_end, ext_len) -> Column:
    """The larger of what both sides leave over at the left and at the right."""
    return F.greatest(F.least(cur_begin, ext_begin), F.least(cur_len - cur_end, ext_len - ext_end))


def kmer_divergence(chain_len: Column, cur_range: Column, ext_range: Column, filtered: Column, k: int, sample_rate: float = 1.0) -> Column:
    """ln(1 / share of k-mers that survive) / k in single precision; null where no length is left."""
    single = lambda c: c.cast("float")
    length = single(F.greatest(cur_range, ext_range) - filtered)
    share = F.least(single(single(single(chain_len) * F.lit(float(sample_rate)).cast("float")) / F.when(length > 0, length)), F.lit(1.0).cast("float"))
    return F.when(length > 0, single(single(F.log(single(F.lit(1.0).cast("float") / share))) / F.lit(float(k)).cast("float")))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def elapsed_seconds(text: Column) -> Column:
    """mm:ss[.f] or h:mm:ss as seconds; null for anything else."""
    p = F.split(text, ":")
    n = lambda i: F.get(p, F.lit(i)).cast("double")
    return F.when(text.rlike(r"^\d+:\d+(\.\d+)?$"), n(0) * 60 + n(1)).when(text.rlike(r"^\d+:\d+:\d+(\.\d+)?$"), n(0) * 3600 + n(1) * 60 + n(2))


def query_dir_name(query_id: Column) -> Column:
    return F.when(query_id < 0, F.concat(F.lit("query_neg"), (-query_id).cast("string"))).otherwise(F.concat(F.lit("query_"), query_id.cast("string")))


def query_group(query_id: Column, groups: Column | int) -> Column:
    """The group of a query: the law by which Spark deals rows of a long out to as many partitions."""
    return F.pmod(F.hash(query_id.cast("bigint")), groups if isinstance(groups, Column) else F.lit(groups))


def group_dir_name(query_id: Column, groups: int) -> Column:
    return F.concat(F.lit("queries_"), query_group(query_id, groups).cast("string"), F.lit(f"_of_{groups}"))


def register(spark: SparkSession) -> None:
    """kmer_encode, kmer_standard and reverse_complement as SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmer_encode(s STRING) RETURNS BIGINT RETURN cast(conv(translate(upper(s), 'ACGT', '0123'), 4, 10) as bigint)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING RETURN reverse(translate(upper(s), 'ACGT', 'TGCA'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION kmer_standard(s STRING) RETURNS STRING RETURN least(upper(s), reverse(translate(upper(s), 'ACGT', 'TGCA')))")
