"""Affine scores of vectors and pooling of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 62
POOL_EPSILON = 1e-7


def project(df: DataFrame, weights: DataFrame, vec: str = "vec", out: str = "scores") -> DataFrame:
    """Add ``out``: one affine score ``W . v + b`` per row ``bit, weights, bias`` of the table.

    The table has at most ``MAX_BITS`` rows (checked), so it travels as one value of a
    scalar subquery and the vectors are not shuffled.
    """
    rows = weights.agg(
        F.array_sort(F.collect_list(F.struct("bit", F.col("weights").cast("array<double>").alias("w"), "bias"))).alias("m")
    ).select(
        F.when(F.size("m") <= MAX_BITS, F.col("m")).otherwise(
            F.raise_error(F.lit(f"more than {MAX_BITS} rows of weights"))
        )
    ).scalar()

    def dot(row):
        products = F.zip_with(row["w"], F.col(vec).cast("array<double>"), lambda a, b: a * b)
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) + row["bias"]

    return df.withColumn("__m", rows).withColumn(out, F.transform("__m", dot)).drop("__m")


def mean_pool(df: DataFrame, keys: Sequence[str], vec: str = "vec", mask: str | None = None) -> DataFrame:
    """Mean vector per key over the rows whose ``mask`` is true; the count gets a small epsilon.

    Components are summed per (key, position) before the shuffle, so a large group costs
    each task one row per component.
    """
    keys = list(keys)
    rows = df if mask is None else df.filter(F.col(mask))
    sums = (
        rows.select(*keys, F.posexplode(vec).alias("__pos", "__x"))
        .groupBy(*keys, "__pos")
        .agg(
            (F.sum(F.col("__x").cast("double")) / (F.count(F.lit(1)) + F.lit(POOL_EPSILON))).alias("__mean")
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("__pos", "__mean")))
    return sums.groupBy(*keys).agg(F.transform(ordered, lambda x: x["__mean"]).alias("pooled"))
