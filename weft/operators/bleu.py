"""BLEU statistics and diversity of sentence triples.

The sentences of a key come together once, whole; the n-grams are counted there, a batch
of keys at a time, so they are never rows of their own and a task holds one batch of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import split_ws, tokens_13a
from weft.operators.ordering import digest
from weft.operators import vocabulary
from weft.session import spread

ORDERS = range(1, 5)
SIDES = range(3)


def _codes(sentences: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for every token of an array of sentences, and the tokens of each sentence."""
    words = sentences.flatten().dictionary_encode(null_encoding="encode")
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), _sizes(sentences)


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _lengths_and_matches(
    codes: np.ndarray, sizes: np.ndarray, group: np.ndarray, side: np.ndarray, n_groups: int, n_sides: int
) -> pa.Array:
    """``len<i>, m<i><n>`` per group: tokens of a side, and its n-grams clipped by the side that has most of the rest.

    ``sizes``, ``group`` and ``side`` tell of each sentence; an n-gram has a count in each
    side of its group. One sort a batch and order.
    """
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    of_group, of_side = group[sentence], side[sentence]
    columns = {f"len{i}": np.bincount(of_group[of_side == i], minlength=n_groups) for i in range(n_sides)}
    kinds = int(codes.max(initial=0)) + 1
    # A gram is known by the shorter one before its last token; those of order 0 are the groups.
    known = of_group
    for n in ORDERS:
        inside = np.flatnonzero(sentence[n - 1 :] == sentence[: len(sentence) - n + 1])
        grams, known = np.unique(known[inside] * kinds + codes[inside + n - 1], return_inverse=True)
        place = np.zeros(len(grams), dtype=np.int64)
        place[known] = of_group[inside]
        counts = np.bincount(known * n_sides + of_side[inside], minlength=len(grams) * n_sides).reshape(-1, n_sides)
        for i in range(n_sides):
            others = np.delete(counts, i, axis=1).max(axis=1)
            clipped = np.minimum(counts[:, i], others)
            columns[f"m{i}{n}"] = np.bincount(place, weights=clipped, minlength=n_groups).astype(np.int64)
        # Grams stand where they begin; the next order looks them up by that place.
        full = np.zeros(len(sentence), dtype=np.int64)
        full[inside] = known
        known = full
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns.values()], names=list(columns))


def _stats_type(sides: int) -> str:
    # In the order of the columns above.
    names = [f"len{i}" for i in range(sides)] + [f"m{i}{n}" for n in ORDERS for i in range(sides)]
    return f"struct<{', '.join(f'{name} bigint' for name in names)}>"


def _stats(members: Column, sides: int) -> Column:
    """The numbers of a group from its ``array<struct(side, tokens)>``."""

    def count(members: pa.Array) -> pa.Array:
        rows = members.flatten()
        group = np.repeat(np.arange(len(members)), _sizes(members))
        side = rows.field("side").to_numpy(zero_copy_only=False).astype(np.int64)
        return _lengths_and_matches(*_codes(rows.field("tokens")), group, side, len(members), sides)

    return F.arrow_udf(count, _stats_type(sides))(members)


def _known(tokens: Column) -> Column:
    return F.coalesce(tokens, F.array().cast("array<string>"))


def bleu_stats(df: DataFrame, keys: Sequence[str], hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Ten numbers per pair of token arrays: lengths, and clipped matches and totals per order.

    ``keys, hyp_len, ref_len, match1, total1, ... match4, total4``.
    """
    keys = list(keys)
    pairs = df.groupBy(*keys).agg(F.collect_list(F.struct(_known(F.col(hyp)).alias("hyp"), _known(F.col(ref)).alias("ref"))).alias("__pairs"))
    members = F.flatten(
        F.transform(
            "__pairs",
            lambda p: F.array(*[F.struct(F.lit(i).alias("side"), p[name].alias("tokens")) for i, name in enumerate(("hyp", "ref"))]),
        )
    )
    stats = pairs.select(*keys, _stats(members, 2).alias("__stats")).select(*keys, "__stats.*")
    return stats.selectExpr(
        *keys,
        "len0 as hyp_len",
        "len1 as ref_len",
        *[part for n in ORDERS for part in (f"m0{n} as match{n}", f"greatest(len0 + 1 - {n}, 0L) as total{n}")],
    )


def smoothed_bleu() -> Column:
    """Sentence BLEU over the columns of ``bleu_stats``: add-one counts, 0 to 100.

    An empty hypothesis scores 0.
    """
    logs = " + ".join(f"ln((1.0D + match{n}) / (1.0D + total{n}))" for n in ORDERS)
    return F.expr(
        f"if(hyp_len = 0, 0.0D, 100.0D * exp(least(0.0D, 1.0D - ref_len / hyp_len) + ({logs}) / 4))"
    )


def mean_sentence_bleu(df: DataFrame, keys: Sequence[str], hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """``n_pairs, mean_bleu``: hypotheses cut to the reference length; empty ones score 0.

    Takes wrapped arrays; both sentence markers are cut off before scoring.
    """
    unwrapped = {c: F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0))) for c in (hyp, ref)}
    inner = df.withColumns(unwrapped).withColumn(hyp, F.slice(hyp, 1, F.size(ref)))
    stats = bleu_stats(inner, keys, hyp, ref)
    return stats.select(smoothed_bleu().alias("bleu")).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("bleu").alias("mean_bleu")
    )


def triples(df: DataFrame, line_no: str = "line_no", text: str = "text") -> DataFrame:
    """``block, pos, text``: three consecutive lines form a block."""
    return df.select(
        F.call_function("div", F.col(line_no), F.lit(3)).alias("block"), F.pmod(F.col(line_no), F.lit(3).cast("bigint")).alias("pos"), text
    )


def sample_blocks(blocks: DataFrame, n: int, seed: int = 2626, block: str = "block") -> DataFrame:
    """``n`` distinct blocks without replacement, repeatable by ``seed``; too few is an error."""
    known = blocks.select(block).distinct()
    total = known.agg(F.count(F.lit(1))).scalar()
    order = digest([block], seed)
    checked = known.filter(
        F.when(total < n, F.raise_error(F.lit(f"fewer than {n} blocks to sample from"))).otherwise(True)
    )
    return checked.orderBy(order, F.col(block)).limit(n)


def sample_lines(blocks: DataFrame, block: str = "block") -> DataFrame:
    """``line_no``: the three lines of each block, as a set."""
    return blocks.select(F.explode(F.array(*[F.col(block) * 3 + i for i in SIDES])).alias("line_no")).distinct()


def _library_bleu(i: int) -> Column:
    """Corpus BLEU of member ``i`` with exponential smoothing and no effective order.

    Over ``len0..len2`` and the clipped matches ``m{i}{n}``. An order without a match halves
    the precision once more; fewer than four tokens score 0.
    """
    a, b = [f"len{j}" for j in SIDES if j != i]
    hyp = f"len{i}"
    # The reference length next to the hypothesis length; the shorter one on a tie.
    near_a, near_b = f"abs({hyp} - {a})", f"abs({hyp} - {b})"
    ref = f"case when {near_a} < {near_b} then {a} when {near_b} < {near_a} then {b} else least({a}, {b}) end"
    logs = []
    for n in ORDERS:
        total = f"({hyp} - {n - 1})"
        unmatched = " + ".join(f"int(m{i}{k} = 0)" for k in range(1, n + 1))
        logs.append(
            f"ln(if(m{i}{n} = 0, 100.0D / (pow(2.0D, {unmatched}) * {total}), 100.0D * m{i}{n} / {total}))"
        )
    return F.expr(
        f"if({hyp} < {len(ORDERS)}, 0.0D,"
        f" exp(least(0.0D, 1.0D - ({ref}) / {hyp}) + ({' + '.join(logs)}) / 4)) as bleu{i}"
    )


def self_bleu(lines: DataFrame, keys: Sequence[str] = ("block",), text: str = "text") -> DataFrame:
    """``keys, bleu0, bleu1, bleu2``: each member of a triple against the other two.

    Takes ``keys, pos, text`` with pos 0, 1, 2; incomplete triples are left out. All three
    scores come from one grouping of the sentences: a gram of a triple carries its count in
    each member, and no member is paired with another by a join.
    """
    keys = list(keys)
    # The tokens are made after the shuffle, so the sentences travel as they are.
    blocks = (
        lines.filter(F.col("pos").isin(*SIDES))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct(F.col("pos").alias("side"), F.col(text).alias("text"))).alias("__members"))
        .filter(F.size("__members") == len(SIDES))
    )
    members = F.transform(
        "__members", lambda m: F.struct(m["side"].alias("side"), _known(tokens_13a(m["text"])).alias("tokens"))
    )
    stats = blocks.select(*keys, _stats(members, len(SIDES)).alias("__stats")).select(*keys, "__stats.*")
    return stats.select(*keys, *[_library_bleu(i) for i in SIDES])


def tag_sequences(
    df: DataFrame,
    keys: Sequence[str],
    lexicon: DataFrame | None,
    text: str = "text",
    unknown: str = "X",
    tagger=None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """``keys, text``: sentences as their token classes.

    ``lexicon`` is ``token, class`` with unique tokens, or pass ``tagger``, a pandas UDF from
    sentence to tag sequence. A lexicon that may not be broadcast (``broadcastable``) is met by
    the distinct tokens of chunks only (``translate``).
    """
    keys = list(keys)
    if tagger is not None:
        return df.select(*keys, tagger(F.col(text)).alias(text))
    if not vocabulary.broadcastable(lexicon, "token", "class", broadcast_bytes):
        words = df.select(*keys, split_ws(text).alias("__tokens"))
        tagged = vocabulary.translate(words, lexicon, keys, "__tokens", "token", "class", "__classes", unknown)
        return tagged.select(*keys, F.array_join("__classes", " ").alias(text))
    placed = spread(df.select(*keys, text), *keys)
    tokens = placed.select(*keys, F.posexplode_outer(split_ws(text)).alias("__pos", "token"))
    tagged = tokens.join(F.broadcast(lexicon.select("token", "class")), "token", "left").withColumn(
        "class", F.when(F.col("__pos").isNotNull(), F.coalesce("class", F.lit(unknown)))
    )
    ordered = F.array_sort(F.collect_list(F.when(F.col("__pos").isNotNull(), F.struct("__pos", "class"))))
    return tagged.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["class"]), " ").alias(text)
    )


def diversity_report(scores: DataFrame, *groups: str) -> DataFrame:
    """``n_triples, mean_bleu, mean_std``: means over triples of the mean and the population deviation."""
    mean = "((bleu0 + bleu1 + bleu2) / 3)"
    spread_out = " + ".join(f"(bleu{i} - {mean}) * (bleu{i} - {mean})" for i in SIDES)
    return scores.groupBy(*groups).agg(
        F.expr("count(1) as n_triples"),
        F.expr(f"round(avg({mean}), 2) as mean_bleu"),
        F.expr(f"round(avg(sqrt(({spread_out}) / 3)), 2) as mean_std"),
    )
