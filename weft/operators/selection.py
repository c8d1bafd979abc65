"""Choosing candidates from n-best lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import MISSING_CODE, NBEST_SEPARATOR, split_code
from weft.operators.ordering import ID_BITS, dense_index, running_start

NBEST_FIELDS = ["block", "field", "p1", "p2"]


def parse_nbest(lines: DataFrame, text: str = "value", mode: str = "FAILFAST") -> DataFrame:
    """Split raw n-best lines into ``block, code, sent, p1, p2``.

    A line has exactly four fields. ``FAILFAST`` raises on any other line,
    ``DROPMALFORMED`` leaves it out (``nbest_rejects`` returns those).
    """
    parts = F.split(F.col(text), r"\Q" + NBEST_SEPARATOR + r"\E", -1)
    whole = F.size(parts) == len(NBEST_FIELDS)
    if mode == "DROPMALFORMED":
        lines = lines.filter(whole)
    elif mode == "FAILFAST":
        parts = F.when(whole, parts).otherwise(
            F.raise_error(F.concat(F.lit("not a four-field n-best line: "), F.col(text)))
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    cut = lines.withColumn("__parts", parts)
    named = cut.select(
        *[c for c in lines.columns if c != text],
        *[F.get("__parts", F.lit(i)).alias(n) for i, n in enumerate(NBEST_FIELDS)],
    )
    return named.withColumn("__split", split_code("field")).select(
        *[c for c in named.columns if c != "field"], "__split.code", "__split.sent"
    )


def nbest_rejects(lines: DataFrame, text: str = "value") -> DataFrame:
    """The lines that ``parse_nbest`` cannot split into four fields."""
    parts = F.split(F.col(text), r"\Q" + NBEST_SEPARATOR + r"\E", -1)
    return lines.filter(F.size(parts) != len(NBEST_FIELDS))


def _lowest(df: DataFrame, keys: list[str], order: list[Column | str], k: int, name: str) -> DataFrame:
    # Spark turns this shape into a group limit on both sides of the shuffle: every task
    # sends at most k rows per group, so a group that holds much of the data stays cheap.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= k)


def nbest_top(nbest: DataFrame, k: int = 3, block: str = "block", rank: str = "rank") -> DataFrame:
    """The first ``k`` candidates of each block, with their place ``pos`` from 0."""
    return _lowest(nbest, [block], [rank], k, "pos").withColumn("pos", F.col("pos").cast("bigint") - 1)


def diverse_top(nbest: DataFrame, k: int = 3, block: str = "block", rank: str = "rank") -> DataFrame:
    """At most ``k`` candidates per block, of codes as different as possible.

    Order of preference: the first candidate of each code, then repeated codes, then
    candidates without a code, each by rank. Equal to walking the list and swapping a
    held candidate for a later one with a new code.

    Two group limits: per (block, code), where at most ``k`` can matter, then per block.
    Adds ``pos`` (place by rank among the kept, from 0) and ``n_kept``.
    """
    by_code = _lowest(nbest, [block, "code"], [rank], k, "__nth")
    flagged = by_code.withColumn("__no_code", F.col("code").isNull()).withColumn(
        "__repeat", ~F.col("__no_code") & (F.col("__nth") > 1)
    )
    kept = _lowest(flagged, [block], ["__no_code", "__repeat", rank], k, "__choice")
    within = Window.partitionBy(block)
    return (
        kept.withColumn("pos", F.row_number().over(within.orderBy(rank)).cast("bigint") - 1)
        .withColumn("n_kept", F.count(F.lit(1)).over(within))
        .drop("__nth", "__no_code", "__repeat", "__choice")
    )


def triple_line(code: str = "code", sent: str = "sent") -> Column:
    """Output line of a kept candidate: its code, or the literal NULL, then the sentence."""
    return F.concat(F.coalesce(F.col(code), F.lit(MISSING_CODE)), F.col(sent))


def block_code_stats(nbest: DataFrame, block: str = "block") -> DataFrame:
    """Rows, rows without a code and distinct codes of each block.

    Counted per (block, code) first, so a large block is spread over its codes.
    """
    per_code = nbest.groupBy(block, "code").agg(F.count(F.lit(1)).alias("__n"))
    return per_code.groupBy(block).agg(
        F.sum("__n").alias("n_rows"),
        F.sum(F.when(F.col("code").isNull(), F.col("__n")).otherwise(0)).alias("n_without_code"),
        F.count("code").alias("n_codes"),
    )


def new_codes(held: DataFrame, offered: DataFrame, block: str = "block") -> DataFrame:
    """Codes offered to a block that it does not hold yet."""
    return (
        offered.select(block, "code")
        .distinct()
        .join(held.select(block, "code").distinct(), [block, "code"], "left_anti")
    )


def blocks_by_run(lines: DataFrame, key: str, line_no: str = "line_no", slice_bits: int = 16) -> DataFrame:
    """Number the runs of equal ``key`` in line order, from 0, as ``block_no``.

    ``line_no`` is unique. Lines are cut into slices of 2**slice_bits line numbers; windows
    stay inside a slice, and what crosses a border (the last key before it and the number
    of runs so far) travels in a table of one row per slice.
    """
    sliced = lines.withColumn("__slice", F.shiftright(line_no, slice_bits))
    inside = Window.partitionBy("__slice").orderBy(line_no)
    borders = sliced.groupBy("__slice").agg(F.max_by(key, line_no).alias("__key"))
    # The slice before this one: the nearest smaller slice number that has lines.
    dense = _with_previous(borders, ID_BITS - slice_bits)
    starts = (
        sliced.join(dense, "__slice")
        .withColumn("__first", F.row_number().over(inside) == 1)
        .withColumn(
            "__before", F.when(F.col("__first"), F.col("__previous")).otherwise(F.lag(key).over(inside))
        )
        .withColumn(
            "__starts",
            (F.col("__first") & ~F.col("__has_previous")) | ~F.col(key).eqNullSafe(F.col("__before")),
        )
    )
    flags = starts.groupBy("__slice").agg(
        F.sum(F.col("__starts").cast("bigint")).alias("__runs"),
    )
    before = running_start(flags, "__slice", "__runs", "__runs_before", ID_BITS - slice_bits).drop("__runs")
    numbered = (
        starts.join(before, "__slice")
        .withColumn(
            "block_no",
            F.col("__runs_before") + F.sum(F.col("__starts").cast("bigint")).over(inside) - 1,
        )
    )
    return numbered.drop("__slice", "__previous", "__has_previous", "__first", "__before", "__starts", "__runs_before")


def _with_previous(borders: DataFrame, bits: int) -> DataFrame:
    numbered = dense_index(borders, "__slice", "__no", bits)
    before = numbered.select((F.col("__no") + 1).alias("__no"), F.col("__key").alias("__previous"))
    return numbered.join(before.withColumn("__has_previous", F.lit(True)), "__no", "left").select(
        "__slice", "__previous", F.coalesce("__has_previous", F.lit(False)).alias("__has_previous")
    )
