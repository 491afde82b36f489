"""Readers of assembly artifacts: FASTA, plain and GFA text, and the compact binary of read alignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header and record layout of the binary payload, little-endian.
MAGIC = b"CUFRALB0"
HEADER = np.dtype([("magic", "S8"), ("header_bytes", "<u4"), ("record_bytes", "<u4"), ("major", "<u4"), ("minor", "<u4"), ("fixtures", "<u8"), ("records", "<u8"), ("inputs", "<u8"), ("fewest", "<u4"), ("most", "<u4"), ("mode", "<u4"), ("reserved", "<u4")])
RECORD = np.dtype([
    ("query_id", "<i8"), ("chain_id", "<i4"), ("segment_id", "<i4"), ("overlap_index", "<i4"), ("candidate_id", "<i8"), ("read_id", "<i8"), ("read_begin", "<i4"), ("read_end", "<i4"), ("read_len", "<i4"),
    ("edge_id", "<i8"), ("edge_left_node", "<i4"), ("edge_right_node", "<i4"), ("edge_seq_id", "<i8"), ("edge_begin", "<i4"), ("edge_end", "<i4"), ("edge_len", "<i4"), ("score", "<i4"), ("seq_divergence", "<f4"),
])
BINARY_SCHEMA = ", ".join(f"{n} {dict(i8='long', i4='int', f4='float')[RECORD[n].str[1:]]}" for n in RECORD.names)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq), upper case, wrapped lines joined. Files are split at records; each starts with a record."""
    raw = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value"))
    header = F.trim(F.regexp_replace(F.substring_index("value", "\n", 1), "\r", ""))
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", ""))
    return raw.select(header.alias("header"), seq.alias("seq")).filter("header != '' or seq != ''")


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines of plain or GFA text without white space at their ends, empty ones left out."""
    return spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("line")).filter("line != ''")


def payload_fault(raw: bytes) -> str | None:
    """What is wrong with a payload's header or size, or None."""
    if len(raw) < HEADER.itemsize:
        return "header"
    h = np.frombuffer(raw, HEADER, 1)[0]
    rules = {
        "magic": bytes(h["magic"]) == MAGIC, "sizes": (h["header_bytes"], h["record_bytes"]) == (HEADER.itemsize, RECORD.itemsize), "version": (h["major"], h["minor"]) == (0, 0),
        "mode": h["mode"] == 1, "reserved": h["reserved"] == 0, "length": len(raw) == HEADER.itemsize + int(h["records"]) * RECORD.itemsize,
    }
    return next((name for name, ok in rules.items() if not ok), None)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The records of all binary payloads at ``path``; a payload that breaks a rule ends the job."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                if fault := payload_fault(raw):
                    raise ValueError(f"{name}: {fault}")
                rows = np.frombuffer(raw, RECORD, offset=HEADER.itemsize)
                for i in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[i : i + 50_000][n])) for n in RECORD.names], names=list(RECORD.names))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, BINARY_SCHEMA)


def payload_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all binary payloads at ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
