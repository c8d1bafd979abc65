"""Equi-joins to a table with unique keys when some keys hold much of the left side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than
# HOT_SHARE hot keys. A hot key is cut into groups of about 1/HOT_SHARE of the rows each;
# over all hot keys that makes fewer than 2 * HOT_SHARE groups.
HOT_SHARE = 10_000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """``__hash, __groups``: hashes of the hot keys of ``df`` and the groups to cut each into.

    Counts eight-byte hashes and not the keys. A collision can only make a cold key pass
    for a hot one, which costs copies and no result.
    """
    hashes = df.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("__hash"))
    total = hashes.agg(F.count(F.lit(1))).scalar()
    return (
        hashes.groupBy("__hash")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") * HOT_SHARE > total)
        .select("__hash", F.ceil(F.col("__n") * HOT_SHARE / total).alias("__groups"))
    )


def join_unique(
    left: DataFrame, right: DataFrame, key: str, row_id: Sequence[str], how: str = "left"
) -> DataFrame:
    """``left`` joined to ``right`` (unique ``key``) by ``how``: left, inner, left_semi or left_anti.

    Rows of a hot key are spread over its groups by their ``row_id``, and the right row of
    a hot key is copied into each of them; everything else is joined once. Rows without a
    key match nothing and are spread as well.
    """
    # Fewer than HOT_SHARE rows of 16 bytes.
    hot = F.broadcast(hot_keys(left, key))
    row_hash = F.xxhash64(*row_id)
    spread = (
        left.withColumn("__hash", F.xxhash64(key))
        .join(hot, "__hash", "left")
        .withColumn(
            "__group",
            F.when(F.col(key).isNull(), F.pmod(row_hash, F.lit(HOT_SHARE)))
            .when(F.col("__groups").isNotNull(), F.pmod(row_hash, "__groups"))
            .otherwise(0),
        )
        .drop("__hash", "__groups")
    )
    copied = (
        right.withColumn("__hash", F.xxhash64(key))
        .join(hot, "__hash", "left")
        .withColumn("__group", F.explode(F.expr("sequence(0L, coalesce(__groups, 1L) - 1)")))
        .drop("__hash", "__groups")
    )
    return spread.join(copied, [key, "__group"], how).drop("__group")
