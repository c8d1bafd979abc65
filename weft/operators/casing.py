"""Truecasing: a sentence starts with the usual casing of its first word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.vocabulary import dictionary_join
from weft.session import freeze


def truecase_model(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``lower, token, cnt``: the most frequent casing of each word, first words not counted.

    Casings with equal counts: the first one in code point order.
    """
    later = df.select(F.explode(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).alias("token"))
    counts = later.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))
    return (
        counts.withColumn("lower", F.lower("token"))
        .groupBy("lower")
        .agg(F.min(F.struct((-F.col("cnt")).alias("n"), "token")).alias("best"))
        .select("lower", "best.token", (-F.col("best.n")).alias("cnt"))
    )


def truecase(df: DataFrame, model: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``df`` with the first token in the casing of the model; unknown words stay.

    The model is written down; it is broadcast if it is small enough (``dictionary_join``).
    """
    casing = freeze(model.select(F.col("lower").alias("__first"), F.col("token").alias("__cased")))
    keyed = df.withColumn("__first", F.lower(F.get(tokens, F.lit(0))))
    joined = dictionary_join(keyed, casing, "__first", "__cased", df.columns)
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return joined.withColumn(
        tokens, F.when(F.col("__cased").isNotNull(), F.concat(F.array("__cased"), rest)).otherwise(F.col(tokens))
    ).drop("__first", "__cased")
