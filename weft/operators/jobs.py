"""End-to-end jobs composed of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import normalise, split_ws, strip, tokenise, wrap
from weft.functions.vectors import binarise, pack_bits
from weft.operators import alignment, batching, bleu, casing, selection, subwords, trees
from weft.operators.budget import token_batches
from weft.operators.projection import project
from weft.operators.vocabulary import DECODER_SPECIALS, build_vocab, token_counts
from weft.session import freeze
from weft.sources import corpus, sinks


@dataclass
class PreparedCorpus:
    """Pairs in pieces, the merges that made them and the decoder vocabulary."""

    pairs: DataFrame
    merges: DataFrame
    pieces: DataFrame
    vocab: DataFrame


def prepare_pairs(
    pairs: DataFrame,
    keys: Sequence[str],
    src_lang: str,
    tgt_lang: str,
    merges: int = 16_000,
    threshold: int = 10,
) -> PreparedCorpus:
    """Clean, truecase and segment ``keys, src, tgt``.

    Punctuation and tokens by language, pairs of 1 to 200 tokens within a length ratio of
    nine, casing of first words per side, one set of merges for both sides, and the
    decoder's vocabulary of the result.
    """
    keys = list(keys)
    plain = pairs.select(
        *keys,
        *[
            split_ws(tokenise(normalise(side, F.lit(lang)), F.lit(lang))).alias(side)
            for side, lang in (("src", src_lang), ("tgt", tgt_lang))
        ],
    )
    # Read by the model, the merges and both sides from here on.
    clean = freeze(alignment.clean_pairs(plain, "src", "tgt"))
    sides = [
        casing.truecase(
            clean.select(*keys, F.col(side).alias("tokens")),
            casing.truecase_model(clean, side),
        ).withColumn("side", F.lit(side))
        for side in ("src", "tgt")
    ]
    cased = freeze(sides[0].unionByName(sides[1]))
    types = freeze(token_counts(cased.select(F.explode("tokens").alias("token"))))
    learnt = subwords.learn_bpe(types, merges)
    pieces = freeze(subwords.piece_counts(types, learnt))
    coded = freeze(subwords.apply_bpe(cased, learnt, [*keys, "side"], pieces=pieces, threshold=threshold))
    vocab = build_vocab(coded.select(F.explode("tokens").alias("token")), specials=DECODER_SPECIALS)
    src, tgt = (
        coded.filter(F.col("side") == side).select(*keys, F.array_join("tokens", " ").alias(side))
        for side in ("src", "tgt")
    )
    return PreparedCorpus(src.join(tgt, keys), learnt, pieces, vocab)


def select_diverse(spark: SparkSession, path: str, out: str | None = None, k: int = 3) -> DataFrame:
    """n-best file to code-diverse triples ``block_no, pos, code, sent, n_kept``; written if asked.

    Blocks are runs of equal ids, so an id that comes back later starts a new block.
    """
    candidates = selection.blocks_by_run(corpus.read_nbest(spark, path), "block", "rank")
    kept = selection.diverse_top(candidates, k, block="block_no")
    if out is not None:
        sinks.write_triples(kept, out, "block_no")
    return kept


def export_codes(
    sources: DataFrame,
    tree_lines: DataFrame,
    vectors: DataFrame,
    bits: int = 8,
    max_tokens: int = 60,
    weights: DataFrame | None = None,
) -> DataFrame:
    """``line_no, src, cfg, code``: lines with a valid tree and a short source, coded by their vector.

    Files of unequal length are an error. ``vectors`` is ``line_no, vec``. With ``weights``
    (``bit, weights, bias``) the bits are the signs of affine scores of the whole vector,
    otherwise those of its first ``bits`` components.
    """
    aligned = alignment.strict_zip(sources, tree_lines).select(
        "line_no", strip("src").alias("src"), strip("cfg").alias("cfg")
    )
    kept = alignment.token_cap(aligned.withColumn("__tokens", split_ws("src")), "__tokens", max_tokens).filter(
        trees.is_valid("cfg")
    )
    # A code is made of its vector before it meets its line, so the vectors do not travel.
    if weights is None:
        coded, signs = vectors, binarise("vec", bits)
    else:
        coded, signs = project(vectors, weights), F.transform("scores", lambda s: F.when(s > 0, 1).otherwise(0))
    codes = freeze(coded.select("line_no", pack_bits(signs).cast("string").alias("code")))
    return kept.join(codes, "line_no").select("line_no", "src", "cfg", "code")


@dataclass
class Diversity:
    """Report per kind, and the tables behind it."""

    report: DataFrame
    lines: DataFrame
    words: DataFrame
    tags: DataFrame


def diversity(
    lines: DataFrame, sample_size: int, lexicon: DataFrame | None = None, tagger=None, out: str | None = None
) -> Diversity:
    """Self-BLEU of a sample of triples, over words and over token classes.

    ``lines`` is ``line_no, text``, three lines per triple. Only sampled lines are scored;
    the sample meets the corpus in a broadcast semi-join, at most ``sample_size`` blocks.
    """
    blocks = bleu.triples(lines, text="text")
    chosen = bleu.sample_blocks(blocks.filter("pos = 2"), sample_size)
    sampled = blocks.join(F.broadcast(chosen), "block", "left_semi").withColumn("text", strip("text"))
    tagged = bleu.tag_sequences(sampled, ["block", "pos"], lexicon, tagger=tagger)
    words, tags = bleu.self_bleu(sampled), bleu.self_bleu(tagged)
    report = bleu.diversity_report(
        words.withColumn("kind", F.lit("words")).unionByName(tags.withColumn("kind", F.lit("tags"))), "kind"
    )
    result = Diversity(report, bleu.sample_lines(chosen), words, tags)
    if out is not None:
        sinks.write_metrics(out, result.lines, words, tags)
    return result


def align_arms(arms: dict[str, DataFrame], targets: DataFrame) -> DataFrame:
    """``arm, block, pos, text, tgt``: triples of several arms beside the targets, three times each.

    An arm is ``block, pos, text``; ``targets`` is ``block, tgt`` with unique blocks.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [rows.select(F.lit(arm).alias("arm"), "block", "pos", "text") for arm, rows in arms.items()],
    )
    return stacked.join(alignment.replicate(targets, len(bleu.SIDES), None), ["block", "pos"])


def compare_arms(aligned: DataFrame) -> DataFrame:
    """``arm, n_triples, mean_bleu, mean_std`` of aligned triples."""
    return bleu.diversity_report(bleu.self_bleu(aligned, ["arm", "block"]), "arm")


def wrapped_tokens(line: Column) -> Column:
    """Default preprocessing of a field: tokens between the sentence markers."""
    return wrap(split_ws(line))


def source_length(src: Column, tgt: Column) -> Column:
    """Default sort key inside a batch."""
    return F.size(src)


def training_data(
    pairs: DataFrame,
    max_length: int = 60,
    n_valid: int = 1000,
    batch_size: int = 64,
    batch_type: str = "sentence",
    truncate: int | None = None,
    seed: int | str = 3,
    preprocess: Callable[[Column], Column] = wrapped_tokens,
    keep: Callable[[Column, Column], Column] | None = None,
    sort_key: Callable[[Column, Column], Column] = source_length,
) -> DataFrame:
    """``line_no, src, tgt, idx, split, batch_id, batch_place, place`` of aligned pairs ``line_no, src, tgt``.

    Preprocessing, filter, truncation, shuffle, split, batches, order in the batch. In
    ``token`` mode the batch size is a token budget and the training part is not rounded.
    ``batch_place`` is the place of the batch in a seeded shuffle of the batches of its
    split. ``preprocess`` makes the token array of a side, ``keep`` replaces the length filter,
    ``sort_key`` orders a batch.
    """
    made = pairs.select("line_no", *[preprocess(F.col(side)).alias(side) for side in ("src", "tgt")])
    if keep is None:
        made = alignment.length_filter(made, "src", "tgt", max_length)
    else:
        made = made.filter(keep(F.col("src"), F.col("tgt")))
    kept = alignment.truncate(made, truncate)
    whole = batch_size if batch_type == "sentence" else None
    placed = batching.train_valid_split(kept, ["line_no"], n_valid, whole, seed)
    in_split = F.when(F.col("split") == "valid", F.col("idx")).otherwise(F.col("idx") - n_valid)
    numbered = freeze(placed.withColumn("in_split", in_split))
    parts = []
    for split in ("valid", "train"):
        rows = numbered.filter(F.col("split") == split)
        if batch_type == "sentence":
            batched = batching.fixed_batches(rows, batch_size, "in_split").drop("pos_in_batch")
        else:
            lengths = rows.select("in_split", F.size("src").alias("n_src"), F.size("tgt").alias("n_tgt"))
            found = token_batches(lengths, batch_size, line_no="in_split").withColumnRenamed("batch_no", "batch_id")
            batched = rows.join(freeze(found), "in_split")
        parts.append(batching.shuffle_batches(batched, "batch_id", f"{seed}:{split}", "batch_place"))
    ordered = batching.order_in_batch(
        parts[0].unionByName(parts[1])
        .withColumn("__key", sort_key(F.col("src"), F.col("tgt")))
        .withColumn("__batch", F.struct("split", "batch_id")),
        "__key",
        "__batch",
    )
    return ordered.drop("__key", "__batch", "in_split")
