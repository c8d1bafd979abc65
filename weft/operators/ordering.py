"""Numbering rows without a global window.

Three ways to number rows 0, 1, 2, ... in an order, none of which sends all rows through
one task:

* ``dense_index``: the order is a unique integer id. Ids fall into blocks of 2**20, so a
  block never holds more than 2**20 rows whatever the distribution.
* ``hashed_index``: the order is an MD5 digest of the key and a seed (a repeatable
  shuffle). Digest prefixes are uniform, so blocks are too.
* ``ranked``: any total order. A range sort splits hot ranges; the layout is frozen in the
  checkpoint folder before partition numbers are read.

The start of each block is a running sum over block counts, taken over a tree of fan-out
2**20, so no window group exceeds 2**20 small rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import freeze

ROW_BITS = 20
FAN_BITS = 20
ID_BITS = 60
DIGEST_BLOCK_DIGITS = 5


def running_start(counts: DataFrame, key: str, value: str, out: str, bits: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows with a smaller integer ``key``.

    ``key`` is unique and has at most ``bits`` significant bits.
    """
    before = (
        Window.partitionBy("__parent").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    )
    nested = counts.withColumn("__parent", F.shiftright(key, FAN_BITS)).withColumn(
        out, F.coalesce(F.sum(value).over(before), F.lit(0).cast("bigint"))
    )
    if bits <= FAN_BITS:
        return nested.drop("__parent")
    totals = counts.groupBy(F.shiftright(key, FAN_BITS).alias("__node")).agg(
        F.sum(value).alias("__total")
    )
    base = out + "_base"
    above = running_start(totals, "__node", "__total", base, bits - FAN_BITS).select(
        F.col("__node").alias("__parent"), base
    )
    return (
        nested.join(above, "__parent")
        .withColumn(out, F.col(out) + F.col(base))
        .drop("__parent", base)
    )


def _number(narrow: DataFrame, block: Column, order: list[Column], name: str, bits: int) -> DataFrame:
    blocked = narrow.withColumn("__block", block)
    starts = running_start(
        blocked.groupBy("__block").agg(F.count(F.lit(1)).alias("__n")),
        "__block",
        "__n",
        "__start",
        bits,
    ).drop("__n")
    place = F.row_number().over(Window.partitionBy("__block").orderBy(*order)) - 1
    return (
        blocked.withColumn("__place", place)
        .join(starts, "__block")
        .withColumn(name, F.col("__start") + F.col("__place"))
        .drop("__block", "__place", "__start")
    )


def dense_index(df: DataFrame, key: str, name: str = "line_no", bits: int = ID_BITS) -> DataFrame:
    """Add ``name``: the rank from 0 of the unique integer ``key``.

    Only the key is sorted; the payload meets its number in an equi-join on the key. Keys are
    0 or more and have at most ``bits`` bits; any other, and NULL, is an error.
    """
    inside = (F.col(key) >= 0) & (F.shiftright(F.col(key).cast("bigint"), bits) == 0)
    checked = F.when(inside, F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit(f"{key} is outside 0 to 2^{bits} - 1: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    )
    numbered = _number(
        df.select(checked.alias(key)), F.shiftright(key, ROW_BITS), [F.col(key)], name, bits - ROW_BITS
    )
    return df.join(numbered, key)


def digest(keys: Sequence[str], seed: int | str) -> Column:
    """MD5 of the key columns and a seed; the source of all repeatable randomness."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hashed_index(
    df: DataFrame, keys: Sequence[str], seed: int | str, name: str = "idx"
) -> DataFrame:
    """Add ``name``: the place of each row in a shuffle given by ``seed``. ``keys`` is unique."""
    keys = list(keys)
    narrow = df.select(*keys).withColumn("__digest", digest(keys, seed))
    block = F.conv(F.substring("__digest", 1, DIGEST_BLOCK_DIGITS), 16, 10).cast("bigint")
    numbered = _number(
        narrow, block, [F.col("__digest"), *[F.col(k) for k in keys]], name, 4 * DIGEST_BLOCK_DIGITS
    )
    return df.join(numbered.drop("__digest"), keys)


def sliced(df: DataFrame, order: Sequence[Column], slice_name: str = "slice") -> DataFrame:
    """Sort by ``order``, cut into slices of similar size and freeze the result.

    Adds ``slice_name`` (grows with the order) and ``__place`` (position inside the slice).
    ``order`` must be total, so that a hot key is cut by the remaining columns.
    """
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__tag", F.monotonically_increasing_id())
        .withColumn(slice_name, F.shiftright("__tag", 33))
        .withColumn("__place", F.col("__tag").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__tag")
    )
    return freeze(tagged)


def ranked(df: DataFrame, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Add ``name``: the rank from 0 under any total order."""
    cut = sliced(df, order, "__slice")
    starts = running_start(
        cut.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n")), "__slice", "__n", "__start", 20
    ).drop("__n")
    # One row per partition of the sort: the side is bounded by the partition count.
    return (
        cut.join(F.broadcast(starts), "__slice")
        .withColumn(name, F.col("__start") + F.col("__place"))
        .drop("__slice", "__place", "__start")
    )


def split_file_parts(df: DataFrame, part_count: int, rows: int | Column, line_no: str = "line_no") -> DataFrame:
    """Add ``part``: equal contiguous parts of floor(rows / part_count) lines.

    The remainder lines at the end belong to no part and get NULL.
    """
    total = F.lit(rows) if isinstance(rows, int) else rows
    size = F.call_function("div", total, F.lit(part_count))
    part = F.call_function("div", F.col(line_no), F.nullif(size, F.lit(0).cast("bigint")))
    return df.withColumn("part", F.when(part < part_count, part))
