"""Seeded permutations of 0 .. n - 1 that are computed row by row, without a sort.

A number below n is a cell of a table of a columns and b rows, a the root of n. Rounds add a
hash of the row to the column and of the column to the row, which can be undone; a result
beyond n goes round again until it falls below. Fewer than a cells lie beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
# A walk of more steps has a probability below 40^-40, and none is that long up to 40^2 numbers; it is an error.
WALKS = 40


def _hash(seed: int | str, turn: Column, x: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), x.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def permuted(df: DataFrame, index: str, n: int | Column, seed: int | str, out: str, inverse: bool = False) -> DataFrame:
    """Add ``out``: the place of ``index`` in the permutation, or, with ``inverse``, the index at that place.

    ``n`` is a number or a scalar; an index outside 0 .. n - 1 is an error.
    """
    sized = df.withColumn("__n", F.lit(n).cast("bigint") if isinstance(n, int) else n.cast("bigint"))
    sized = sized.withColumn("__a", F.greatest(F.lit(1), F.ceil(F.sqrt("__n"))).cast("bigint"))
    sized = sized.withColumn("__b", F.call_function("div", F.col("__n") + F.col("__a") - 1, F.col("__a")))
    n_, a, b = F.col("__n"), F.col("__a"), F.col("__b")
    sign = F.lit(-1 if inverse else 1)

    def turn(cell: Column, k: Column) -> Column:
        left, right = cell["l"], cell["r"]
        return F.struct(
            F.when(k % 2 == 1, F.pmod(left + sign * _hash(seed, k, right), a)).otherwise(left).alias("l"),
            F.when(k % 2 == 0, F.pmod(right + sign * _hash(seed, k, left), b)).otherwise(right).alias("r"),
        )

    turns = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))

    def step(x: Column) -> Column:
        start = F.struct((x % a).alias("l"), F.call_function("div", x, a).alias("r"))
        return F.aggregate(turns, start, turn, lambda cell: cell["l"] + a * cell["r"])

    inside = (F.col(index) >= 0) & (F.col(index) < n_)
    checked = F.when(inside, F.col(index).cast("bigint")).otherwise(F.raise_error(F.lit(f"{index} is not below the size of the permutation")))
    # The walk starts from a place that counts as beyond, so every index takes one step at least.
    state = F.struct(checked.alias("x"), F.lit(False).alias("done"))

    def settle(s: Column, _: Column) -> Column:
        moved = F.when(s["done"], s["x"]).otherwise(step(s["x"]))
        # The inner transform names the moved number, so that it is computed once.
        return F.transform(F.array(moved), lambda x: F.struct(x.alias("x"), (x < n_).alias("done")))[0]

    found = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), state, settle)
    placed = sized.withColumn("__s", found)
    value = F.when(F.col("__s")["done"], F.col("__s")["x"]).otherwise(F.raise_error(F.lit("the walk of a permutation did not end")))
    return placed.withColumn(out, value).drop("__n", "__a", "__b", "__s")
