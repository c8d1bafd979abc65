"""Shards by rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import freeze

# 53 random bits make an exact double.
RANDOM_BITS = 53


def rendezvous(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard of a key: the one with the highest score, of equal scores the smallest.

    The score of a shard is -weight / ln(u), u a uniform hash of key and shard, so a shard
    gets its weight's share of the keys, and it depends on no other shard: one more shard
    takes keys only into itself. Keys count by their text, so an id has one shard in any
    integer type. A null key column hashes like a value of its own.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("shards need positive weights")
    # A null is a mark of its own, so (null, 1) and (1, null) differ.
    parts = [p for k in keys for p in (k.isNull(), k.cast("string"))]
    scores = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(*parts, F.lit(shard)), 64 - RANDOM_BITS)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << RANDOM_BITS))
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.array_max(F.array(*scores)).getField("shard")).cast("int")


def with_slots(df: DataFrame, shard: str = "shard", name: str = "slot") -> DataFrame:
    """Add ``name``: numbers 0, 1, 2, ... within each shard, whatever repeats or is null.

    The rows are written once with the place they have there. Places are counted per shard
    and written part; no window holds more rows than one part has, or than there are parts.
    """
    placed = freeze(df.withColumn("__place", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__place", 33))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(shard, "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("bigint")))
        .drop("__n")
    )
    inside = F.row_number().over(Window.partitionBy(shard, "__part").orderBy("__place")) - 1
    return (
        placed.withColumn("__inside", inside)
        .join(starts, [shard, "__part"])
        .withColumn(name, F.col("__start") + F.col("__inside"))
        .drop("__place", "__part", "__inside", "__start")
    )


def shard_documents(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    added: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size``: bytes of the text and 1. ``grown_shard``: the shard with one more of weight
    ``added``. Rows with equal keys share a shard; a null key is a key; a null text counts
    as empty; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous([F.col(key)], list(weights)).alias("shard"),
        rendezvous([F.col(key)], [*weights, added]).alias("grown_shard"),
    )
    return with_slots(rows).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
