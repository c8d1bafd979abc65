"""Datasets of sources with trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import split_ws, strip
from weft.operators import alignment, trees
from weft.operators.batching import bootstrap_pad, train_valid_split
from weft.operators.ordering import split_file_parts
from weft.operators.vocabulary import encode
from weft.session import freeze


def loader_rows(
    sources: DataFrame,
    tree_lines: DataFrame,
    vocab: DataFrame,
    max_tokens: int = 80,
    depth_limit: int = 0,
    limit_datapoints: int = 0,
    truncate: int | None = None,
    part: tuple[int, int, int | Column] | None = None,
) -> DataFrame:
    """``line_no, ids, nodes``: sources as ids beside the nodes of their trees.

    In order: part ``(k, n, rows)`` of the file, the first ``limit_datapoints`` lines, trees
    that parse, sources of at most ``max_tokens`` tokens, the first ``truncate`` rows left.
    ``nodes`` is an array of structs in id order.
    """
    rows = alignment.zip_lines(sources, tree_lines)
    if part is not None:
        k, n, total = part
        size = F.call_function("div", F.lit(total) if isinstance(total, int) else total, F.lit(n))
        rows = split_file_parts(rows, n, total).filter(F.col("part") == k).drop("part")
        rows = rows.withColumn("line_no", F.col("line_no") - size * k)
    rows = alignment.first_lines(rows, limit_datapoints).withColumn("tokens", split_ws(strip("src")))
    # Read by the trees, of which validity is a by-product, and by the ids.
    rows = freeze(alignment.token_cap(rows, "tokens", max_tokens).select("line_no", "tokens", "cfg"))
    parsed = trees.node_arrays(rows.select("line_no", "cfg"), depth_limit)
    coded = encode(rows, vocab, ["line_no"])
    return alignment.truncate(coded.join(parsed, "line_no"), truncate)


def loader_dataset(
    sources: DataFrame, tree_lines: DataFrame, vocab: DataFrame, n_valid: int = 1000, seed: int | str = 3, **options
) -> DataFrame:
    """``stands_for, line_no, ids, nodes, idx, split``: ``loader_rows`` padded, shuffled and split.

    Rows that filters took are replaced by survivors drawn with replacement, so there are
    as many as the sources have lines (of the first ``limit_datapoints``, if given); the first ``n_valid`` of a seeded shuffle are ``valid``.
    """
    kept = freeze(loader_rows(sources, tree_lines, vocab, **options))
    every = alignment.first_lines(sources.select("line_no"), options.get("limit_datapoints", 0))
    padded = bootstrap_pad(kept, every, seed=seed)
    return train_valid_split(padded, ["stands_for"], n_valid, seed=seed)
