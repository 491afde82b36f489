"""A training corpus from raw documents in four stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import neardup, packing, quality, repeats
from readloom.llm.common import materialize, table, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now; others are dropped."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go.

    Null, empty and short texts stay, as do languages without a trusted document; repeated rows are judged alike.
    """
    return quality.judge(docs.select(*COLUMNS), quality.trusted_ids(spark, sf_dir)).filter("accepted").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages and lines go; a document of which nothing is left goes with them.

    Documents that lose nothing stay as they are, null and empty texts as well.
    """
    cleaned = repeats.remove_repeats(docs.select(*COLUMNS))
    return as_documents(cleaned.filter((F.size("runs") == 0) | (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != "")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one document stays, the smallest doc_id.

    Where doc_ids repeat or are null, rows are told apart by their place, and the first place of a group stays; texts
    without words are linked with nothing and all stay.
    """
    docs = docs.select(*COLUMNS)
    several = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    key = "doc_id"
    if not several.isEmpty():
        docs, key = materialize(docs.withColumn("row_place", F.monotonically_increasing_id()), "rows"), "row_place"
    judged = neardup.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"), shingle=5, percent=80)
    gone = materialize(judged.filter("not kept").select(F.col("doc_id").alias(key)), "near-duplicates")
    gone = F.broadcast(gone) if gone.count() <= quality.BROADCAST_IDS else gone
    return docs.join(gone, key, "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, with the pieces' places and ids; a null text is its end id alone."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("near duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: SQL can express neither the tokenizer nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each one's result written and read back as the next one's documents."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
