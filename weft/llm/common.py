"""What the operators of this package share: tables, word rules, Arrow maps, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import weft
from weft.session import freeze

# Functions travel to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(weft)

# Words are runs of anything but the six white-space characters of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
# Rows in an Arrow batch: whole texts travel in them, so a batch stays small.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column | str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size so that a batch of long texts fits a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` over small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def worker_cache(name: str, make: Callable[[], object]):
    """A value that a Python worker makes once and keeps for its later tasks."""
    kept = pyspark.__dict__.setdefault("_weft_worker_cache", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, schema)], schema=schema
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node reachable from each node of ``edges(a, b)``.

    Two alternating steps: every node takes the smallest of its neighbours and itself and
    points its larger neighbours to it, then its smaller ones. Stars remain after a number
    of rounds that grows with the logarithm of the longest path. The smallest neighbour is
    a grouping that combines before the shuffle, and reaches the edges by a join that adaptive
    execution can split, so a node with very many neighbours is no task of its own. Each
    round is written below the checkpoint folder: a lost executor repeats one round at most.
    Nodes without edges do not appear.
    """

    def lowest(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("low"))
        return pairs.join(low, "u").withColumn("m", F.least("u", "low"))

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a != b").distinct()

    def stars(pairs: DataFrame) -> bool:
        """Whether every node points to one root and no root points further."""
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return odd.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()

    current = freeze(tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    for _ in range(rounds):
        if stars(current):
            roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = lowest(both).filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = lowest(large)
        current = freeze(
            tidy(
                small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                    small.select(F.col("u").alias("a"), F.col("m").alias("b"))
                )
            )
        )
    raise RuntimeError(f"no stars after {rounds} rounds")
