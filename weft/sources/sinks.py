"""Writers. Text keeps the order of its lines: part files in name order are the corpus.

Everything is written by ``commit_tables``: whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import shard_name
from weft.operators.alignment import export_line
from weft.operators.selection import triple_line
from weft.sources.commit import commit_tables, read_table
from weft.sources.corpus import LINES, VOCAB

TRIPLES_SUFFIX = ".en.filtered"


def _write_ordered(df: DataFrame, order: list[str], line: str, path: str) -> None:
    # One range shuffle; a range partition becomes one part file, numbered in range order.
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    commit_tables(path, {LINES: placed.select(F.col(line).alias("value"))}, text=[LINES])


def write_lines(df: DataFrame, path: str, text: str = "text", line_no: str = "line_no") -> None:
    _write_ordered(df, [line_no], text, path)


def write_codes(df: DataFrame, path: str, line_no: str = "line_no") -> None:
    """Code export: ``src, cfg, code`` between tabs, in line order."""
    _write_ordered(df.withColumn("__line", export_line("src", "cfg", "code")), [line_no], "__line", path)


def write_target(df: DataFrame, path: str, line_no: str = "line_no") -> None:
    """Merged target lines, in line order."""
    _write_ordered(df, [line_no], "line", path)


def write_triples(df: DataFrame, path: str, block: str = "block") -> None:
    """Kept candidates, one line each, by block and place; ``path`` gets the usual suffix."""
    lines = df.withColumn("__line", triple_line())
    _write_ordered(lines, [block, "pos"], "__line", path + TRIPLES_SUFFIX)


def save_vocab(vocab: DataFrame, path: str) -> None:
    commit_tables(path, {VOCAB: vocab.select("id", "token", "cnt")})


def write_shards(df: DataFrame, path: str, text: str = "text") -> None:
    """One folder per shard, named by the padded shard number, lines in order."""
    named = df.withColumn("shard", shard_name("shard_id"))
    # The writer wants rows sorted by folder and would sort anew, without the lines, if they were not.
    placed = named.repartitionByRange("shard_id").sortWithinPartitions("shard", "line_in_shard")
    commit_tables(path, {LINES: placed.select("shard", F.col(text).alias("value"))}, text=[LINES], by=["shard"])


def write_metrics(path: str, lines: DataFrame, words: DataFrame, tags: DataFrame) -> None:
    """The sampled lines and both tables of scores, in one commit."""
    commit_tables(path, {"lines": lines, "bleus": words, "pos_bleus": tags})


def read_metrics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of ``write_metrics``."""
    scores = "block long, bleu0 double, bleu1 double, bleu2 double"
    return (
        read_table(spark, path, "lines", "line_no long"),
        read_table(spark, path, "bleus", scores),
        read_table(spark, path, "pos_bleus", scores),
    )
