"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchmark.llm.common import read, register

SHARDS = 24


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of highest score ``-weight / ln(u)``, u a uniform hash of key and shard number.

    A shard's score depends on nothing but the key, its number and its weight, so adding a shard or
    raising a weight moves rows to that shard alone. Ties go to the smaller number. Keys hash as
    strings; a null key is a key of its own. A weight of zero or less takes no rows.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11)
            uniform = (bits.cast("double") + 0.5) * F.lit(2.0**-53)
            scores.append(F.struct((F.lit(-float(weight)) / F.ln(uniform)).alias("s"), F.lit(-shard).alias("n")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return -best["n"]


def add_slots(rows: DataFrame, shard: str = "shard", slot: str = "slot", cells: int = 256) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Equal rows are counted before the shuffle and written out again at the end. A shard is cut into
    ``cells`` by the hash of whole rows, so no task numbers a whole shard and a hot key is spread;
    the cells' sizes (shards x cells rows, the bound of the broadcast) give the first slot of each.
    """
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__cell", F.pmod(F.xxhash64(*columns), F.lit(cells)))
    sizes = counted.groupBy(shard, "__cell").agg(F.sum("__n").alias("__size"))
    before = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(shard).alias("__shard"), F.col("__cell").alias("__c"),
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy(shard, "__cell").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(
        F.broadcast(starts), (F.col(shard) == F.col("__shard")) & (F.col("__cell") == F.col("__c"))
    )
    first = F.col("__start") + F.col("__in")
    return placed.select(*columns, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(slot))


def shard_documents(
    docs: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Place every document by its key; texts are read for size and checksum, never shuffled.

    Null texts have no bytes and the checksum of the empty text; equal rows get slots of their own;
    an empty table gives no rows; further columns are ignored, whatever their names.
    """
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        rendezvous(F.col(key), grown).cast("int").alias("grown_shard"),
    )
    return add_slots(rows)


@register("op3_sharding")
def op3_sharding(spark: SparkSession, d: str) -> DataFrame:
    return shard_documents(read(spark, d, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
