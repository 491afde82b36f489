"""Operator 5: sharding by vector bin packing.

Copies of one text form a group with a vector of bytes, tokens and rows. Every group that outweighs a unit is placed
whole, as one vector; only a group that outweighs a shard is split, into as many vectors as shards it fills. The light
rest is gathered by hash into a fixed number of units, a vector each. The vectors, at most three times ``shards *
units_per_shard`` of them whatever the input, are placed one by one, largest first, each on the shard where the dot
product of its vector with the shard's residual capacity is highest. Rows move only once, without their text, to be
numbered inside their unit; a heavy group has many units for that, on the shard of its vector.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of_text, materialize, table

SHARDS = 24
UNITS_PER_SHARD = 512
#: Weights of bytes, tokens and rows in the dot product. The law that holds is that of bytes.
WEIGHTS = (0.8, 0.1, 0.1)


def place(vectors: np.ndarray, shards: int, weights=WEIGHTS) -> np.ndarray:
    """The shard of each unit. vectors: bytes, tokens, rows by unit; ties go to the lower shard."""
    total = vectors.sum(axis=0).astype(float)
    need = vectors / np.where(total > 0, total, 1) * shards * np.sqrt(np.array(weights))
    residual = np.tile(np.sqrt(np.array(weights)), (shards, 1))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(need)), -need.sum(axis=1))):
        out[i] = best = int((residual @ need[i]).argmax())
        residual[best] -= need[i]
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, units_per_shard: int = UNITS_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row.

    Size is the UTF-8 bytes of the text (null: none) plus 8. Equal texts share a shard unless their group outweighs
    one; then its rows are dealt over as few shards as it fills by a hash of doc_id, since no shard could hold it and
    stay level. Null and empty texts are one group; an empty table gives no rows; rows that repeat each get a slot;
    null doc_ids pass through; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            (F.length(text) - F.length(F.translate(text, " \n", "")) + 1).cast("long").alias("tokens"),
            crc32_of_text(text).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
        ),
        "shard-rows",
    )
    light = shards * units_per_shard
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1.0, total / light)
    # At most ``light`` groups can be larger than the total over ``light``.
    heavy = rows.groupBy("group").agg(F.sum("size").alias("size")).filter(F.col("size") > most).toPandas().sort_values("group")
    heavy["parts"] = np.ceil(heavy["size"] / most).astype("int64")
    heavy["vectors"] = np.ceil(heavy["size"] * shards / max(total, 1)).astype("int64")
    heavy["base"] = light + heavy["parts"].cumsum() - heavy["parts"]
    split = spark.createDataFrame(heavy[["group", "parts", "base"]].astype("int64"), "group long, parts long, base long")
    part = F.col("base") + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts"))
    rows = rows.join(F.broadcast(split), "group", "left").withColumn("unit", F.coalesce(part, F.pmod("group", F.lit(light))))
    units = rows.groupBy("unit").agg(*sums).toPandas().sort_values("unit").reset_index(drop=True)
    units["vector"] = units["unit"]
    own = (units["unit"] >= light).to_numpy()
    at = np.searchsorted(heavy["base"].to_numpy(), units["unit"][own], side="right") - 1
    base, vectors = heavy["base"].to_numpy()[at], heavy["vectors"].to_numpy()[at]
    units.loc[own, "vector"] = base + (units["unit"][own].to_numpy() - base) % vectors
    whole = units.groupby("vector")[["size", "tokens", "n"]].sum()
    units["shard"] = units["vector"].map(dict(zip(whole.index, place(whole.to_numpy(np.float64).reshape(-1, 3), shards), strict=True)))
    units["first"] = units.groupby("shard")["n"].cumsum() - units["n"]
    placed = spark.createDataFrame(units[["unit", "shard", "first"]].astype("int64"), "unit long, shard long, first long") if len(units) else spark.createDataFrame([], "unit long, shard long, first long")
    order = Window.partitionBy("unit").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.join(F.broadcast(placed), "unit")
        .withColumn("slot", F.col("first") + F.row_number().over(order) - 1)
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of all documents, shards near equal in bytes; equal texts in one shard."""
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
