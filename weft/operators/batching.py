"""Shards, batches, splits and padding of datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.permutation import permuted
from weft.functions.text import shard_name
from weft.operators.budget import token_batches  # noqa: F401
from weft.operators.ordering import dense_index, digest, hashed_index
from weft.operators.skew import join_unique
from weft.session import spread

SHARD_LINES = 30_000
VALID_ROWS = 1000
PAD = 0


def _div(a: Column | str, b: Column | int) -> Column:
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, b if isinstance(b, Column) else F.lit(b))


def shard(df: DataFrame, lines: int = SHARD_LINES, line_no: str = "line_no") -> DataFrame:
    """Add ``shard_id`` and ``line_in_shard``: consecutive shards of ``lines`` lines."""
    return df.withColumn("shard_id", _div(line_no, lines)).withColumn(
        "line_in_shard", F.pmod(F.col(line_no), F.lit(lines).cast("bigint"))
    )


def combine_shards(df: DataFrame, lines: int = SHARD_LINES, line_no: str = "line_no") -> DataFrame:
    """The line numbers back from ``shard_id`` and ``line_in_shard``."""
    return df.withColumn(line_no, F.col("shard_id") * lines + F.col("line_in_shard")).drop("shard_id", "line_in_shard")


def shard_summary(df: DataFrame) -> DataFrame:
    """``shard_id, name, n_lines, n_chars`` per shard."""
    return (
        df.groupBy("shard_id")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line").cast("bigint")).alias("n_chars"))
        .withColumn("name", shard_name("shard_id"))
    )


def sharded_map(
    df: DataFrame,
    fn: Callable[[list[str]], list[str]],
    text: str = "line",
    line_no: str = "line_no",
    out: str = "output",
    lines: int = SHARD_LINES,
) -> DataFrame:
    """``line_no, out``: a batch function over the lines of every shard, shortest lines first.

    Shards are spread over the tasks, and ``fn`` gets lists of lines of similar length, one
    Arrow batch each. It must return as many lines as it gets. Only the line and its number
    go through Python; other columns come back with a join on the line number.
    """
    placed = spread(shard(df.select(line_no, text), lines, line_no), "shard_id").sortWithinPartitions(
        "shard_id", F.length(text), line_no
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = fn(batch[text].tolist())
            if len(answers) != len(batch):
                raise ValueError(f"{len(answers)} outputs for {len(batch)} lines")
            yield pd.DataFrame({line_no: batch[line_no], out: answers})

    return placed.select(line_no, text).mapInPandas(run, f"{line_no} bigint, {out} string")


def fixed_batches(df: DataFrame, batch_size: int, idx: str = "idx", drop_last: bool = False) -> DataFrame:
    """Add ``batch_id, pos_in_batch``; ``drop_last`` leaves an incomplete last batch out."""
    batched = df.withColumn("batch_id", _div(idx, batch_size)).withColumn(
        "pos_in_batch", F.pmod(F.col(idx), F.lit(batch_size).cast("bigint"))
    )
    if not drop_last:
        return batched
    total = df.agg(F.count(F.lit(1))).scalar()
    return batched.filter(F.col("batch_id") < _div(total, batch_size))


def shuffle_batches(df: DataFrame, batch: str = "batch_no", seed: int | str = 3, out: str = "place") -> DataFrame:
    """Add ``out``: the place of each row's batch in a seeded shuffle of the batches 0, 1, 2, ...

    The place is computed from the number; nothing is sorted or moved. ``restore_batches``
    takes the batch back from it.
    """
    return permuted(df, batch, df.agg(F.max(batch) + 1).scalar(), seed, out)


def restore_batches(df: DataFrame, place: str = "place", seed: int | str = 3, out: str = "batch_no") -> DataFrame:
    """Add ``out``: the batch that ``shuffle_batches`` put at ``place``; all places are there."""
    return permuted(df, place, df.agg(F.max(place) + 1).scalar(), seed, out, inverse=True)


def order_in_batch(df: DataFrame, length: str, batch: str = "batch_id", line_no: str = "line_no") -> DataFrame:
    """Add ``place``: rank in the batch by length, then line."""
    by_length = Window.partitionBy(batch).orderBy(length, line_no)
    return df.withColumn("place", F.row_number().over(by_length).cast("bigint") - 1)


def pad_batch(df: DataFrame, ids: str = "ids", batch: str = "batch_id", pad: int = PAD) -> DataFrame:
    """Fill the id arrays of a batch with ``pad`` up to the longest one."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return (
        df.withColumn("__longest", longest)
        .withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), F.col("__longest") - F.size(ids))))
        .drop("__longest")
    )


def shuffle(df: DataFrame, keys: Sequence[str], seed: int | str) -> DataFrame:
    """Add ``idx``: the place of the row in a repeatable shuffle."""
    return hashed_index(df, keys, seed, "idx")


def train_valid_split(
    df: DataFrame,
    keys: Sequence[str],
    n_valid: int = VALID_ROWS,
    batch_size: int | None = None,
    seed: int | str = 3,
) -> DataFrame:
    """Add ``idx, split``: the first ``n_valid`` shuffled rows are ``valid``, the rest ``train``.

    With ``batch_size`` the training part is cut to a multiple of it.
    """
    placed = shuffle(df, keys, seed).withColumn("split", F.when(F.col("idx") < n_valid, "valid").otherwise("train"))
    if batch_size is None:
        return placed
    total = df.agg(F.count(F.lit(1))).scalar()
    whole = _div(F.greatest(total - n_valid, F.lit(0).cast("bigint")), batch_size) * batch_size
    return placed.filter(F.col("idx") < n_valid + whole)


def bootstrap_pad(
    survivors: DataFrame, every: DataFrame, line_no: str = "line_no", seed: int | str = 3
) -> DataFrame:
    """Survivors, and for each lost row of ``every`` one survivor drawn with replacement.

    Adds ``stands_for``: the line that the row fills (its own for a survivor).
    """
    numbered = dense_index(survivors, line_no, "__row")
    n = survivors.agg(F.count(F.lit(1))).scalar()
    lost = every.select(F.col(line_no).alias("stands_for")).join(
        survivors.select(F.col(line_no).alias("stands_for")), "stands_for", "left_anti"
    )
    draw = F.conv(F.substring(digest(["stands_for"], seed), 1, 15), 16, 10).cast("bigint")
    # A few survivors may have to stand for many lost rows.
    drawn = join_unique(lost.withColumn("__row", F.pmod(draw, n)), numbered, "__row", ["stands_for"], "inner")
    kept = numbered.withColumn("stands_for", F.col(line_no))
    columns = [*survivors.columns, "stands_for"]
    return kept.select(columns).unionByName(drawn.select(columns))
