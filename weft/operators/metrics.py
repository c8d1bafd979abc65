"""Tables of training metrics and data fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.vectors import argmax, nll
from weft.operators.ordering import sliced

# Loss that one point of BLEU is worth, and the first "best" of each kind.
LOSS_PER_BLEU = 0.02
WORST_LOW = 65535.0
WORST_HIGH = -10000.0


def epoch_means(log: DataFrame, keys: Sequence[str] = ("run", "epoch", "name"), value: str = "value") -> DataFrame:
    """Mean of each metric per key."""
    return log.groupBy(*keys).agg(F.avg(value).alias(value))


def mix(bleu: Column | str, loss: Column | str) -> Column:
    """Trade-off of both, lower is better: loss in units of BLEU minus BLEU."""
    bleu, loss = (F.col(c) if isinstance(c, str) else c for c in (bleu, loss))
    return -bleu + loss / LOSS_PER_BLEU


def with_mix(
    means: DataFrame, bleu: str, loss: str, keys: Sequence[str] = ("run", "epoch"), value: str = "value"
) -> DataFrame:
    """Add a metric ``mix`` where both metrics exist, and store BLEU negated."""
    pairs = means.groupBy(*keys).agg(
        F.max(F.when(F.col("name") == bleu, F.col(value))).alias("__bleu"),
        F.max(F.when(F.col("name") == loss, F.col(value))).alias("__loss"),
    )
    mixed = pairs.filter("__bleu is not null and __loss is not null").select(
        *keys, F.lit("mix").alias("name"), mix("__bleu", "__loss").alias(value)
    )
    negated = means.withColumn(value, F.when(F.col("name") == bleu, -F.col(value)).otherwise(F.col(value)))
    return negated.select(*keys, "name", value).unionByName(mixed)


def best_so_far(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str = "value",
    maximise: bool = False,
) -> DataFrame:
    """Add ``best_before, improved``: the best value before this row, and whether it is met.

    Equal values count as improved. A run may hold most of the log, so no window covers a
    run: the log is cut into slices in (key, order) order, the best of earlier slices comes
    from a table of one row per key and slice, and windows stay inside a slice.
    """
    keys, order = list(keys), list(order)
    pick, worst = (F.max, WORST_HIGH) if maximise else (F.min, WORST_LOW)
    narrow = F.greatest if maximise else F.least
    cut = sliced(log, [F.col(c) for c in keys + order], "__slice").drop("__place")
    per_slice = cut.groupBy(*keys, "__slice").agg(pick(value).alias("__of_slice"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.withColumn("__carried", pick("__of_slice").over(earlier)).drop("__of_slice")
    inside = (
        Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = cut.join(carried, [*keys, "__slice"])
    best = narrow(F.lit(worst), F.coalesce("__carried", F.lit(worst)), F.coalesce(pick(value).over(inside), F.lit(worst)))
    better = (F.col(value) >= F.col("best_before")) if maximise else (F.col(value) <= F.col("best_before"))
    return joined.withColumn("best_before", best).withColumn("improved", better).drop("__slice", "__carried")


def label_eval(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """``n, accuracy, mean_nll`` of class scores against labels."""
    return df.select(
        F.when(argmax(scores) == F.col(label), 1.0).otherwise(0.0).alias("__hit"), nll(scores, label).alias("__nll")
    ).agg(F.count(F.lit(1)).alias("n"), F.avg("__hit").alias("accuracy"), F.avg("__nll").alias("mean_nll"))


def ordered_fingerprint(df: DataFrame, idx: str, text: str, rows: int = 1000) -> DataFrame:
    """``n, fingerprint``: last eight hex digits of SHA-1 over at most ``rows`` lines in order.

    For a validation split; more rows than that are an error, use ``set_fingerprint``.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(text).alias("t"))))
    head = df.withColumn(
        idx,
        F.when(F.col(idx) < rows, F.col(idx)).otherwise(
            F.raise_error(F.lit(f"an ordered fingerprint takes at most {rows} rows"))
        ),
    )
    return head.agg(
        F.count(F.lit(1)).alias("n"),
        F.right(F.sha1(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").cast("binary")), F.lit(8)).alias(
            "fingerprint"
        ),
    )


def set_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """``n, fingerprint``: order-independent, for tables of any size.

    The sum of a 60-bit digest of each row, so that equal rows add up. A value is marked
    and so is NULL, which differs from an empty string and from a column left out.
    """
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    hashed = F.conv(F.substring(F.md5(F.concat_ws("\n", *marked)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(hashed).cast("decimal(38,0)").alias("fingerprint"))
