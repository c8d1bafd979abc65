"""BLEU and diversity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import alignment, jobs, selection
from weft.operators import bleu as op
from weft.operators.ordering import digest
from weft.operators.vocabulary import lookup
from weft.plans import views
from weft.plans.selection import _DIVERSE, nbest_parse
from weft.plans.vocabulary import VOCAB, vocab_build
from weft.sources import tables

SAMPLE_SIZE = 50
SEED = 2626
PAIR = ["conv_id", "turn"]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pairs(spark, sf_dir).select(
        *PAIR, text.split_ws("src").alias("hyp"), text.split_ws("tgt").alias("ref")
    )


def bleu_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.bleu_stats(_pairs(spark, sf_dir), PAIR)


def smoothed_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bleu_stats(spark, sf_dir).select(*PAIR, F.round(op.smoothed_bleu(), 6).alias("bleu"))


def mean_sentence_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = _pairs(spark, sf_dir).select(*PAIR, text.wrap("hyp").alias("hyp"), text.wrap("ref").alias("ref"))
    return op.mean_sentence_bleu(wrapped, PAIR).select("n_pairs", F.round("mean_bleu", 6).alias("mean_bleu"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.numbered(spark, sf_dir).select("line_no", F.col("line").alias("text"))


def triples_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.triples(_lines(spark, sf_dir))


def sample_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a sample of whole blocks."""
    every = triples_build(spark, sf_dir)
    whole = every.filter("pos = 2").select("block")
    chosen = op.sample_blocks(whole, SAMPLE_SIZE, SEED)
    return every.join(F.broadcast(chosen), "block", "left_semi")


def self_bleu_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = op.self_bleu(triples_build(spark, sf_dir))
    return scores.select("block", *[F.round(f"bleu{i}", 6).alias(f"bleu{i}") for i in op.SIDES])


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token, class``: the class of a token is the magnitude of its frequency rank."""
    return lookup(vocab_build(spark, sf_dir)).select(
        "token", F.concat(F.lit("B"), F.length(F.col("id").cast("string")).cast("string")).alias("class")
    )


def _tagged_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tag_sequences(triples_build(spark, sf_dir), ["block", "pos"], lexicon(spark, sf_dir))


def self_bleu_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = op.self_bleu(_tagged_triples(spark, sf_dir))
    return scores.select("block", *[F.round(f"bleu{i}", 6).alias(f"bleu{i}") for i in op.SIDES])


def _lengths(lines: pd.Series) -> pd.Series:
    return lines.map(lambda line: " ".join(str(len(token)) for token in line.split()))


def tags_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token classes by a function of the user's: here the length of each token."""
    tagger = F.pandas_udf(_lengths, "string")
    return op.tag_sequences(_lines(spark, sf_dir), ["line_no"], None, tagger=tagger)


def diversity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = triples_build(spark, sf_dir).withColumn("kind", F.lit("words"))
    tags = _tagged_triples(spark, sf_dir).withColumn("kind", F.lit("tags"))
    scores = op.self_bleu(words.unionByName(tags), ["kind", "block"])
    return op.diversity_report(scores, "kind")


def sampling_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as it is, its tokens, and their number, as three passes."""
    lines = _lines(spark, sf_dir)
    tokens = text.split_ws("text")
    passes = [
        lines,
        lines.select("line_no", F.array_join(tokens, " ").alias("text")),
        lines.select("line_no", F.size(tokens).cast("string").alias("text")),
    ]
    return alignment.interleave(passes)


def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity of three ways to take three candidates per block, beside the size of the block."""
    nbest = nbest_parse(spark, sf_dir)
    sizes = selection.block_code_stats(nbest).select("block", F.col("n_rows").cast("string").alias("tgt"))
    sampled = nbest.withColumn("draw", digest(["rank"], SEED))
    arms = {
        "baseline": selection.nbest_top(nbest),
        "sampling": selection.nbest_top(sampled, rank="draw"),
        "treecode": selection.diverse_top(nbest),
    }
    named = {arm: rows.withColumnRenamed("sent", "text") for arm, rows in arms.items()}
    return jobs.compare_arms(jobs.align_arms(named, sizes))


QUERIES = {
    "bleu_stats": bleu_stats,
    "smoothed_bleu": smoothed_bleu,
    "mean_sentence_bleu": mean_sentence_bleu,
    "triples_build": triples_build,
    "sample_triples": sample_triples,
    "self_bleu_words": self_bleu_words,
    "self_bleu_tags": self_bleu_tags,
    "tags_by_function": tags_by_function,
    "diversity_report": diversity_report,
    "sampling_triples": sampling_triples,
    "arm_comparison": arm_comparison,
}

_ORDERS = " UNION ALL ".join(f"SELECT {n} AS n" for n in op.ORDERS)


def _grams(source: str, keys: str) -> str:
    """Counts of the n-grams of ``source(keys, side, t)`` per key and side."""
    return f"""
g AS (
  SELECT {keys}, side, n, unnest(list_transform(range(1, len(t) - n + 2),
         lambda i: array_to_string(list_slice(t, i, i + n - 1), ' '))) AS gram
  FROM {source}, ({_ORDERS}) o WHERE len(t) >= n
),
c AS (SELECT {keys}, side, n, gram, count(*) AS k FROM g GROUP BY ALL)"""


_STATS = f"""{views.PAIRS},
p AS (SELECT conv_id, turn, {views.tokens('src')} AS h, {views.tokens('tgt')} AS r FROM v_pairs),
sides AS (SELECT conv_id, turn, 'h' AS side, h AS t FROM p UNION ALL SELECT conv_id, turn, 'r', r FROM p),
{_grams('sides', 'conv_id, turn')},
m AS (
  SELECT a.conv_id, a.turn, a.n, sum(least(a.k, b.k)) AS m
  FROM c a JOIN c b ON (a.conv_id, a.turn, a.n, a.gram) = (b.conv_id, b.turn, b.n, b.gram)
  WHERE a.side = 'h' AND b.side = 'r' GROUP BY ALL
),
stats AS (
  SELECT conv_id, turn, CAST(len(h) AS BIGINT) AS hyp_len, CAST(len(r) AS BIGINT) AS ref_len,
         {', '.join(f'''CAST(coalesce((SELECT m FROM m WHERE m.conv_id = p.conv_id AND m.turn = p.turn AND m.n = {n}), 0) AS BIGINT) AS match{n},
         CAST(greatest(len(h) + 1 - {n}, 0) AS BIGINT) AS total{n}''' for n in op.ORDERS)}
  FROM p
)"""

_SENTENCE = (
    "CASE WHEN hyp_len = 0 THEN 0.0 ELSE 100 * exp(least(0, 1 - ref_len / hyp_len) + ("
    + " + ".join(f"ln((1.0 + match{n}) / (1.0 + total{n}))" for n in op.ORDERS)
    + ") / 4) END"
)


def _tokens_13a(column: str) -> str:
    sql = f"replace(replace(replace(lower({column}), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, plain in text.TOKENISE_13A:
        sql = f"replace({sql}, '{entity}', '{plain}')"
    sql = f"' ' || {sql} || ' '"
    steps = [
        ("([{-~\\[-` -&(-+:-@/])", " \\1 "),
        ("([^0-9])([.,])", "\\1 \\2 "),
        ("([.,])([^0-9])", " \\1 \\2"),
        ("([0-9])(-)", "\\1 \\2 "),
    ]
    for pattern, by in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{by}', 'g')"
    return views.tokens(sql)


def _self_bleu(source: str, keys: str) -> str:
    """``scores(keys, bleu0, bleu1, bleu2)`` from ``source(keys, pos, text)`` with whole blocks only."""
    parts = keys.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in parts)
    using = f"({keys}, n, gram)"
    return f"""
whole AS (SELECT {keys} FROM {source} GROUP BY ALL HAVING count(*) = 3),
sides AS (SELECT {keys}, pos AS side, {_tokens_13a('text')} AS t FROM {source} JOIN whole USING ({keys})),
{_grams('sides', keys)},
others AS (
  SELECT {', '.join('a.' + k for k in parts)}, a.side, a.n, a.gram, a.k, coalesce(max(b.k), 0) AS r
  FROM c a LEFT JOIN c b ON {on} AND a.n = b.n AND a.gram = b.gram AND a.side <> b.side GROUP BY ALL
),
matched AS (SELECT {keys}, side, n, sum(least(k, r)) AS m FROM others GROUP BY ALL),
lens AS (
  SELECT {', '.join('a.' + k for k in parts)}, a.side, len(a.t) AS len,
         arg_min(len(b.t), (abs(len(a.t) - len(b.t)), len(b.t))) AS ref
  FROM sides a JOIN sides b ON {on} AND a.side <> b.side GROUP BY ALL
),
precisions AS (
  SELECT {keys}, side, n, len, ref, m,
         sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}, side ORDER BY n) AS zeros
  FROM lens JOIN matched USING ({keys}, side)
),
each AS (
  SELECT {keys}, side, any_value(len) AS len, any_value(ref) AS ref,
         sum(ln(CASE WHEN m = 0 THEN 100.0 / (2 ** zeros * (len - n + 1)) ELSE 100.0 * m / (len - n + 1) END)) AS logs
  FROM precisions GROUP BY ALL
),
score AS (
  SELECT {keys}, side,
         CASE WHEN len < 4 THEN 0.0 ELSE CASE WHEN len < ref THEN exp(1 - ref / len) ELSE 1 END * exp(logs / 4) END AS bleu
  FROM each
),
scores AS (
  SELECT {', '.join('w.' + k for k in parts)},
         {', '.join(f'coalesce(max(bleu) FILTER (side = {i}), 0.0) AS bleu{i}' for i in op.SIDES)}
  FROM whole w LEFT JOIN score a ON {' AND '.join(f'a.{k} = w.{k}' for k in parts)} GROUP BY ALL
)"""


_REPORT = """count(*) AS n_triples, round(avg((bleu0 + bleu1 + bleu2) / 3), 2) AS mean_bleu,
       round(avg(list_stddev_pop([bleu0, bleu1, bleu2])), 2) AS mean_std"""

_TAGS = f"""{VOCAB}, {views.TRIPLES},
lexicon AS (SELECT token, 'B' || length(CAST(id AS VARCHAR)) AS class FROM v_lookup),
said AS (SELECT block, pos, unnest(range(0, len(t))) AS i, unnest(t) AS token FROM (SELECT block, pos, {views.tokens('text')} AS t FROM v_triples)),
classes AS (
  SELECT block, pos, string_agg(coalesce(x.class, 'X'), ' ' ORDER BY i) AS text
  FROM said LEFT JOIN lexicon x ON x.token = said.token GROUP BY block, pos),
tagged AS (SELECT v.block, v.pos, coalesce(c.text, '') AS text FROM v_triples v LEFT JOIN classes c ON c.block = v.block AND c.pos = v.pos)"""

ORACLE = {
    "bleu_stats": f"WITH {_STATS} SELECT * FROM stats",
    "smoothed_bleu": f"WITH {_STATS} SELECT conv_id, turn, round({_SENTENCE}, 6) AS bleu FROM stats",
    # Hypotheses are cut to the reference length first.
    "mean_sentence_bleu": f"""
WITH {_STATS.replace(f"{views.tokens('src')} AS h", f"list_slice({views.tokens('src')}, 1, len({views.tokens('tgt')})) AS h")}
SELECT count(*) AS n_pairs, round(avg({_SENTENCE}), 6) AS mean_bleu FROM stats""",
    "triples_build": f"WITH {views.TRIPLES} SELECT block, pos, text FROM v_triples",
    "sample_triples": f"""
WITH {views.TRIPLES},
chosen AS (SELECT block FROM v_triples WHERE pos = 2
           ORDER BY md5(block || ':{SEED}'), block LIMIT {SAMPLE_SIZE})
SELECT block, pos, text FROM v_triples WHERE block IN (SELECT block FROM chosen)""",
    "tags_by_function": f"""
WITH {views.NUMBERED}
SELECT line_no, array_to_string(list_transform({views.tokens('line')}, lambda t: length(t)), ' ') AS text FROM v_numbered""",
    "self_bleu_words": f"""
WITH {views.TRIPLES}, {_self_bleu('v_triples', 'block')}
SELECT block, round(bleu0, 6) AS bleu0, round(bleu1, 6) AS bleu1, round(bleu2, 6) AS bleu2 FROM scores""",
    "self_bleu_tags": f"""
WITH {_TAGS}, {_self_bleu('tagged', 'block')}
SELECT block, round(bleu0, 6) AS bleu0, round(bleu1, 6) AS bleu1, round(bleu2, 6) AS bleu2 FROM scores""",
    "diversity_report": f"""
WITH {_TAGS},
both_kinds AS (SELECT 'words' AS kind, block, pos, text FROM v_triples
               UNION ALL SELECT 'tags', block, pos, text FROM tagged),
{_self_bleu('both_kinds', 'kind, block')}
SELECT kind, {_REPORT} FROM scores GROUP BY kind""",
    "sampling_triples": f"""
WITH {views.NUMBERED}, d AS (SELECT line_no, line, {views.tokens('line')} AS t FROM v_numbered)
SELECT line_no, CAST(pos AS BIGINT) AS pos, line_no * 3 + pos AS out_no,
       CASE pos WHEN 0 THEN line WHEN 1 THEN array_to_string(t, ' ') ELSE CAST(len(t) AS VARCHAR) END AS text
FROM d, range(0, 3) AS r(pos)""",
    "arm_comparison": f"""{_DIVERSE},
arms AS (
  SELECT 'baseline' AS arm, block, row_number() OVER (PARTITION BY block ORDER BY rank) - 1 AS pos, sent AS text FROM v_nbest
  UNION ALL
  SELECT 'sampling', block, row_number() OVER (PARTITION BY block ORDER BY md5(rank || ':{SEED}')) - 1, sent FROM v_nbest
  UNION ALL
  SELECT 'treecode', block, pos, sent FROM kept),
three AS MATERIALIZED (SELECT * FROM arms WHERE pos < 3),
{_self_bleu('three', 'arm, block')}
SELECT arm, {_REPORT} FROM scores GROUP BY arm""",
}
