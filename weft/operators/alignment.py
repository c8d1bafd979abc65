"""Line-aligned corpora: zipping, filtering, replicating and merging with codes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators.ordering import dense_index
from weft.operators.skew import join_unique


def zip_lines(*sides: DataFrame, on: str = "line_no") -> DataFrame:
    """Lines of two or more corpora with equal numbers; ends with the shortest."""
    return reduce(lambda left, right: left.join(right, on, "inner"), sides)


def strict_zip(left: DataFrame, right: DataFrame, on: str = "line_no") -> DataFrame:
    """Like ``zip_lines``, but a line without a counterpart is an error."""
    # The sides are shuffled as they come, so a join beside this one may share their shuffles.
    here, there = F.col(f"__left.{on}"), F.col(f"__right.{on}")
    lost = here.isNull() | there.isNull()
    error = F.raise_error(F.concat(F.lit("line without counterpart: "), F.coalesce(here.cast("string"), there.cast("string"), F.lit("NULL"))))
    named = [(on, here), *[(c, F.col(f"__{side}.{c}")) for side, df in (("left", left), ("right", right)) for c in df.columns if c != on]]
    joined = left.alias("__left").join(right.alias("__right"), here == there, "full_outer")
    # Every column asks, or a filter on one of them would take the lost lines away before.
    return joined.select(*[F.when(lost, error).otherwise(c).alias(name) for name, c in named])


def unmatched(left: DataFrame, right: DataFrame, on: str = "line_no") -> DataFrame:
    """``line, side``: lines that one corpus has and the other lacks."""
    only_left = left.select(on).join(right.select(on), on, "left_anti").withColumn("side", F.lit("left"))
    only_right = right.select(on).join(left.select(on), on, "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def length_filter(df: DataFrame, src: str, tgt: str, max_length: int = 60) -> DataFrame:
    """Keep pairs of wrapped token arrays with 2 < length <= ``max_length`` on both sides."""
    return df.filter(
        (F.size(src) > 2) & (F.size(tgt) > 2) & (F.size(src) <= max_length) & (F.size(tgt) <= max_length)
    )


def token_cap(df: DataFrame, tokens: str, max_tokens: int = 80) -> DataFrame:
    """Keep rows of at most ``max_tokens`` tokens."""
    return df.filter(F.size(tokens) <= max_tokens)


def clean_pairs(
    df: DataFrame, src: str, tgt: str, low: int = 1, high: int = 200, ratio: float = 9
) -> DataFrame:
    """Keep pairs of token arrays of ``low`` to ``high`` tokens, neither ``ratio`` times the other."""
    n_src, n_tgt = F.size(src), F.size(tgt)
    return df.filter(
        n_src.between(low, high)
        & n_tgt.between(low, high)
        & (n_src <= n_tgt * ratio)
        & (n_tgt <= n_src * ratio)
    )


def first_lines(df: DataFrame, limit: int, line_no: str = "line_no") -> DataFrame:
    """The first ``limit`` lines of the file; zero or less means all."""
    return df.filter(F.col(line_no) < limit) if limit > 0 else df


def truncate(df: DataFrame, limit: int | None, line_no: str = "line_no") -> DataFrame:
    """The first ``limit`` rows that are left, whatever their line numbers."""
    if limit is None:
        return df
    return dense_index(df, line_no, "__row").filter(F.col("__row") < limit).drop("__row")


def replicate(df: DataFrame, times: int = 3, line_no: str | None = "line_no") -> DataFrame:
    """Each line ``times`` times, as ``pos`` 0, 1, ... under ``out_no = line_no * times + pos``."""
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint")))
    copied = df.withColumn("pos", copies)
    return copied if line_no is None else copied.withColumn("out_no", F.col(line_no) * times + F.col("pos"))


def interleave(passes: Sequence[DataFrame], line_no: str = "line_no") -> DataFrame:
    """Outputs of several passes over one corpus as triples: line by line, pass by pass."""
    tagged = [p.withColumn("pos", F.lit(i).cast("bigint")) for i, p in enumerate(passes)]
    return reduce(DataFrame.unionByName, tagged).withColumn(
        "out_no", F.col(line_no) * len(passes) + F.col("pos")
    )


def export_line(src: Column | str, cfg: Column | str, code: Column | str) -> Column:
    """Line of a code export: three fields between tabs."""
    return F.concat_ws("\t", src, cfg, code)


def _digest(key: Column) -> Column:
    # Stands for source and tree where rows are shuffled and sorted by them.
    return F.unhex(F.sha2(key, 256))


def parse_export(lines: DataFrame, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """``key, code`` of a code export: the last line of each (src, cfg) wins. Keys are those of ``corpus_key``.

    Lines of fewer than three fields after stripping are left out, so an empty ``src`` is
    lost. The last two fields are the tree and the code, the rest is the source.
    """
    parts = F.split(text.strip(value), "\t", -1)
    fields = lines.withColumn("__parts", parts).filter(F.size("__parts") >= 3)
    n = F.size("__parts")
    keyed = fields.select(
        line_no,
        _digest(F.array_join(F.slice("__parts", 1, n - 1), "\t")).alias("key"),
        text.code_tokens(F.get("__parts", n - 1)).alias("code"),
    )
    return keyed.groupBy("key").agg(F.max_by("code", line_no).alias("code"))


def corpus_key(src: str = "src", cfg: str = "cfg") -> Column:
    """The SHA-256 of source and tree."""
    return _digest(F.concat_ws("\t", text.strip(src), text.strip(cfg)))


def merge_codes(
    corpus: DataFrame,
    export_lines: DataFrame,
    row_id: Sequence[str],
    err_mode: str = "target",
) -> DataFrame:
    """Put the code of ``(src, cfg)`` before ``tgt``: columns of ``row_id``, ``line``, ``status``.

    A pair that the export lacks gives status ``missing`` and the error marker followed by
    the target, or, with ``err_mode="reference"``, by the last line of the export.
    """
    table = parse_export(export_lines)
    joined = join_unique(corpus.withColumn("key", corpus_key()), table, "key", row_id, "left")
    if err_mode == "target":
        tail = text.strip("tgt")
    elif err_mode == "reference":
        tail = export_lines.agg(F.max_by("value", "line_no")).scalar()
    else:
        raise ValueError(f"unknown err_mode {err_mode!r}")
    missing = F.col("code").isNull()
    return joined.select(
        *row_id,
        F.when(missing, F.concat(F.lit(text.MISSING_MERGE), tail))
        .otherwise(text.with_code("code", text.strip("tgt")))
        .alias("line"),
        F.when(missing, "missing").otherwise("merged").alias("status"),
    )


def unlabelled(corpus: DataFrame, export_lines: DataFrame, row_id: Sequence[str]) -> DataFrame:
    """The corpus rows whose ``(src, cfg)`` the export lacks."""
    table = parse_export(export_lines).select("key")
    return join_unique(corpus.withColumn("key", corpus_key()), table, "key", row_id, "left_anti").drop("key")
