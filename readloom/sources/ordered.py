"""Text files read in parallel, with the order of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, id, line, bytes): lines end at line feeds alone; within a block, ids go up by one in its order."""
    m = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(m["file_path"].alias("path"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"), m["file_size"].alias("file_size"))


def _blocks(lines: DataFrame) -> DataFrame:
    """(path, block, first, before, bytes, file_size): a row a block of a file, with the number of the file's lines before it.

    Blocks are the splits that tasks read; a file has as many as its size asks for, so the window is over few rows.
    """
    each = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("file_size").alias("file_size"))
    so_far = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(each.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))), "blocks")


def numbered_lines(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """(path, line_no, line): every line of the files with its number in its file, from 0; empty lines count but are left out.

    Files are read in splits like any text. A first pass counts the lines of each split, the second one numbers them.
    """
    lines = _lines(spark, path)
    rows = _number(lines, _blocks(lines))
    return rows if keep_empty else rows.filter("line != ''")


def _number(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    small = F.broadcast(blocks.select("path", "block", "first", "before"))  # a row a split of the scan, as the driver has them too
    return lines.join(small, ["path", "block"]).select("path", (F.col("before") + F.col("id") - F.col("first")).cast("int").alias("line_no"), "line")


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(line) the first ``n`` lines that are not empty, in the order of the file, of one file; reading stops after them.

    They come from the file's first split; only if that has fewer are all lines numbered.
    """
    head = _lines(spark, path).filter("block = 0 and line != ''").limit(n)
    found = materialize(head.select("line"), "first-lines")
    if found.count() == n:
        return found
    return numbered_lines(spark, path).orderBy("line_no").limit(n).select("line")


def read_headed(spark: SparkSession, path: str, schema_line: str, columns: str) -> DataFrame:
    """Rows of files that start with a schema line and a header of ``columns``; by name, in any order of columns.

    Files are read in splits; the two first lines of each are looked up once. A file without them, or whose last line does
    not end, is an error at once; a row of another width ends the job when it is read.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    lines = _lines(spark, path)
    files = len(lines.inputFiles())
    blocks = _blocks(lines)
    numbered = _number(lines, blocks)
    top = numbered.filter("line_no < 2").groupBy("path").agg(F.max(F.when(F.col("line_no") == 0, F.col("line"))).alias("named"), F.split(F.max(F.when(F.col("line_no") == 1, F.col("line"))), "\t", -1).alias("header"))
    heads = materialize(top, "headers")
    fits = (F.col("named") == schema_line) & (F.sort_array("header") == F.sort_array(F.array(*map(F.lit, names))))
    wrong = heads.filter(~F.coalesce(fits, F.lit(False))).select("path").take(3)
    cut = blocks.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.max("file_size").alias("size")).filter("bytes != size").select("path").take(3)
    if wrong or cut or heads.count() != files:
        raise ValueError(f"{[r['path'] for r in wrong + cut] or path}: not a file of {schema_line}")
    parts = F.split("line", "\t", -1)
    place = lambda n: (F.array_position("header", n) - 1).cast("int")
    right = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat("path", F.lit(": a row of the wrong width"))).cast("array<string>"))
    rows = numbered.filter("line_no > 1").join(F.broadcast(heads.select("path", "header")), "path").select(right.alias("parts"), "header")  # a row a file, as the driver has them too
    return rows.select(*[F.get("parts", place(n)).cast(c.split()[1]).alias(n) for n, c in zip(names, columns.split(", "), strict=True)])
