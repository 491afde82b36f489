"""Overlaps of arriving reads with the edges of a graph, batch by batch.

A file stream over the folder of reads: a run takes the files that no run before it took, and ends. What was taken is in
the checkpoint. Each batch of files goes through the candidate join, the group prefilter and chaining, and its overlaps
are written to a folder of the batch's number, by strand. A batch that is run again takes the place of its first try, so a
run that was cut off, or one that finds nothing new, leaves the same output. Nothing of earlier batches is read again.

    python -m jobs.read_overlaps --reads DIR --edges DIR --out DIR --checkpoint DIR [--config FILE] [--set NAME=JSON]

Reads without an id, or shorter than a k-mer, have no overlaps; edges are read anew in every batch.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import dna
from readloom.operators.chains import OVERLAP_SCHEMA, ChainParams
from readloom.plans.alignment import overlap_reads
from readloom.sources.tables import bases

from .common import command_line, log_of, read_table, settings

NAME = "read_overlaps"
SCHEMA = f"{OVERLAP_SCHEMA}, batch int, strand string"


def parameters(config: dict) -> ChainParams:
    hang = config["max_overhang"]
    return ChainParams(k=config["kmer_size"], min_overlap=config["min_overlap"], check_overhang=hang is not None, max_overhang=hang or 0)


def _source(path: str, files: list[str]) -> str:
    """``path`` as a file stream takes it: a path that is a file itself must come as a pattern (of that file alone)."""
    path = path.rstrip("/")
    alone = len(files) == 1 and files[0].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]
    return f"{path[:-1]}[{path[-1]}]" if alone else path


def run(spark: SparkSession, reads: str, edges: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Takes what is new in ``reads``; how many batches, reads and overlaps that were. Returns when the stream has ended."""
    config, log = config or settings(NAME), log_of(NAME)
    p, took = parameters(config), {"batches": 0, "reads": 0, "overlaps": 0}

    def sequences(df: DataFrame) -> DataFrame:
        seq: Column = F.upper("seq") if config["letters_are_bases"] else bases(F.col("seq"))
        return df.withColumn("seq", seq)

    known = sequences(read_table(spark, edges, config["edges_format"], config["edge_columns"]))
    there = spark.read.format(config["reads_format"]).load(reads)
    arriving = spark.readStream.format(config["reads_format"]).schema(there.schema).option("maxFilesPerTrigger", config["files_per_batch"]).load(_source(reads, there.inputFiles()))
    arriving = arriving.selectExpr(*[f"{expression} as `{name}`" for name, expression in config["read_columns"].items()])

    def write(batch: DataFrame, n: int) -> None:
        mine = sequences(batch).filter(F.col("read_id").isNotNull() & F.col("seq").isNotNull())
        target = f"{out}/batch={n}"
        overlap_reads(mine, known, config["most_places_of_a_kmer"], p).withColumn("strand", F.when(dna.strand(F.col("ext_id")) == "+", "forward").otherwise("reverse")).write.mode("overwrite").partitionBy("strand").parquet(target)
        took["batches"] += 1
        took["reads"] += (a := batch.count())
        took["overlaps"] += (b := spark.read.schema(SCHEMA).option("basePath", out).parquet(target).count())
        log.info("batch %d: read %d rows of %s, wrote %d overlaps to %s", n, a, reads, b, target)

    query = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows of %s in %d batches against %s, wrote %d overlaps to %s", took["reads"], reads, took["batches"], edges, took["overlaps"], out)
    return took


def read_output(spark: SparkSession, out: str) -> DataFrame:
    """All overlaps found so far, with their batch and strand."""
    return spark.read.schema(SCHEMA).option("basePath", out).parquet(out)


if __name__ == "__main__":
    sys.exit(command_line(__doc__, {"reads": "folder of reads", "edges": "folder of graph edges", "out": "folder of overlaps", "checkpoint": "folder of what was taken"}, run, NAME))
