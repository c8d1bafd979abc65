"""Aligned corpora, codes and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text, vectors
from weft.operators import alignment as op
from weft.operators import jobs, projection
from weft.operators.ordering import dense_index, ranked
from weft.plans import views
from weft.session import freeze
from weft.sources import tables

SOURCE_CAP = 60
CODE_BITS = 8


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.numbered(spark, sf_dir).select("line_no", F.col("line").alias("src"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_lines(spark, sf_dir).select("line_no", F.col("line").alias("tgt"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("cfg"))
    return dense_index(items, "item_id").select("line_no", "cfg")


def aligned_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.zip_lines(_documents(spark, sf_dir), _pages(spark, sf_dir), _benchmark(spark, sf_dir))


def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = op.unmatched(_documents(spark, sf_dir), _pages(spark, sf_dir))
    also = op.unmatched(_benchmark(spark, sf_dir), _pages(spark, sf_dir))
    return (
        lost.withColumn("files", F.lit("documents-pages"))
        .unionByName(also.withColumn("files", F.lit("benchmark-pages")))
        .groupBy("files", "side")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"))
    )


def _pair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pairs(spark, sf_dir).select(
        "conv_id", "turn", text.split_ws("src").alias("src"), text.split_ws("tgt").alias("tgt")
    )


def pair_len_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = _pair_tokens(spark, sf_dir).select(
        "conv_id", "turn", text.wrap("src").alias("src"), text.wrap("tgt").alias("tgt")
    )
    return op.length_filter(wrapped, "src", "tgt").select(
        "conv_id", "turn", F.array_join("src", " ").alias("src"), F.array_join("tgt", " ").alias("tgt")
    )


def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.clean_pairs(_pair_tokens(spark, sf_dir), "src", "tgt").select(
        "conv_id",
        "turn",
        F.size("src").cast("bigint").alias("n_src"),
        F.size("tgt").cast("bigint").alias("n_tgt"),
    )


def parse_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.lines(spark, sf_dir).withColumn("tokens", text.split_ws("line"))
    return op.token_cap(rows, "tokens", 80).select("doc_id", "line_no", "line")


def crop_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    cropped = text.crop(text.split_ws("line"), 150)
    return tables.lines(spark, sf_dir).select(
        "doc_id", "line_no", F.size(cropped).cast("bigint").alias("n_tokens"), F.array_join(cropped, " ").alias("cropped")
    )


def hash_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all components of a vector, one for each eight of them."""
    part = F.posexplode(F.expr(f"transform(sequence(0, size(embedding) - 1, {CODE_BITS}), i -> slice(embedding, i + 1, {CODE_BITS}))"))
    return (
        tables.table(spark, sf_dir, "embeddings")
        .select("vec_id", part.alias("part", "vec"))
        .select("vec_id", "part", vectors.binarise("vec", CODE_BITS).alias("bits"))
        .select("vec_id", "part", F.array_join(F.col("bits").cast("array<string>"), "").alias("bits"), vectors.pack_bits("bits").alias("code"))
    )


def hash_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes from affine scores; one weight row per label, the mean vector of the label."""
    vecs = tables.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    scored = projection.project(vecs, tables.label_weights(spark, sf_dir))
    return scored.select(
        "vec_id", vectors.pack_bits(F.transform("scores", lambda s: F.when(s > 0, 1).otherwise(0))).alias("code")
    )


def saturating_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("pos", "x")
    ).select("vec_id", "pos", F.round(vectors.saturating_sigmoid("x"), 6).alias("soft_bit"))


def _coded(spark: SparkSession, sf_dir: str, files: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Labelling job over all lines: valid trees and short sources only, codes by the whole vector."""
    return jobs.export_codes(*files, max_tokens=SOURCE_CAP, weights=tables.label_weights(spark, sf_dir))


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, tables.labelling(spark, sf_dir))


def _line(exported: DataFrame, name: str) -> DataFrame:
    return exported.select("line_no", op.export_line("src", "cfg", "code").alias(name))


def code_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line(_exported(spark, sf_dir), "line")


def _corpus_and_export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The corpus, and the lines of its export.

    Lines, trees and codes are written once. Both sides, and the count of the hot keys, read them
    through the same shuffles by line, which one plan makes once.
    """
    numbered = F.col("line_no").isNotNull()
    sources, trees, vectors = tables.labelling(spark, sf_dir)
    # An inner join looks for this by itself; told to both joins, it leaves their shuffles equal.
    sources, trees = sources.filter(numbered), freeze(trees).filter(numbered)
    corpus = op.zip_lines(sources, trees).withColumn("tgt", F.col("src"))
    return corpus, _line(_coded(spark, sf_dir, (sources, trees, vectors)), "value")


def make_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corpus line merged with the export; lines that the labelling left out are missing."""
    return op.merge_codes(*_corpus_and_export(spark, sf_dir), ["line_no"])


def unlabelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.unlabelled(*_corpus_and_export(spark, sf_dir), ["line_no"]).select("line_no", "src")


def tripled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in (conversation, turn) order, numbered, then each three times."""
    pairs = ranked(tables.pairs(spark, sf_dir), [F.col("conv_id"), F.col("turn")], "line_no")
    return op.replicate(pairs, 3, "line_no").select("conv_id", "turn", "pos", F.col("out_no"), "src", "tgt")


QUERIES = {
    "aligned_zip": aligned_zip,
    "alignment_check": alignment_check,
    "pair_len_filter": pair_len_filter,
    "clean_corpus": clean_corpus,
    "parse_ready": parse_ready,
    "crop_tokens": crop_tokens,
    "hash_codes": hash_codes,
    "hash_projected": hash_projected,
    "saturating_sigmoid": saturating_sigmoid,
    "code_export": code_export,
    "make_target": make_target,
    "unlabelled_rows": unlabelled_rows,
    "tripled_pairs": tripled_pairs,
}

_FILES = f"""{views.NUMBERED},
a AS (SELECT line_no, line AS src FROM v_numbered),
b AS (SELECT row_number() OVER (ORDER BY page_id, pos) - 1 AS line_no, tgt FROM (
  SELECT page_id, unnest(range(0, len(l))) AS pos, unnest(l) AS tgt FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages))),
c AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS line_no, text AS cfg FROM benchmark)"""

_PAIR_TOKENS = f"""{views.PAIRS},
t AS (SELECT conv_id, turn, {views.tokens('src')} AS s, {views.tokens('tgt')} AS g FROM v_pairs)"""

# The last export line of each source and tree; sources are stripped, empty ones are lost.
_CODED = f"""{views.LABELLING},
v_export AS (SELECT line_no, trim(src) AS src, cfg, code FROM v_labelling WHERE len({views.tokens('src')}) <= {SOURCE_CAP}),
coded AS (SELECT src, cfg, arg_max(code, line_no) AS code FROM v_export WHERE src <> '' GROUP BY src, cfg)"""

_MERGED = """
merged AS (
  SELECT line_no,
         CASE WHEN c.src IS NULL THEN '<ERR>' || trim(l.src)
              ELSE '<c' || (CAST(c.code AS BIGINT) + 1) || '> <eoc> ' || trim(l.src) END AS line,
         CASE WHEN c.src IS NULL THEN 'missing' ELSE 'merged' END AS status
  FROM v_labelling l LEFT JOIN coded c ON c.src = trim(l.src) AND c.cfg = l.cfg)"""

ORACLE = {
    "aligned_zip": f"WITH {_FILES} SELECT * FROM a JOIN b USING (line_no) JOIN c USING (line_no)",
    "alignment_check": f"""
WITH {_FILES}, pairs AS (
  SELECT 'documents-pages' AS files, a.line_no AS l, b.line_no AS r FROM a FULL JOIN b ON a.line_no = b.line_no
  UNION ALL
  SELECT 'benchmark-pages', c.line_no, b.line_no FROM c FULL JOIN b ON c.line_no = b.line_no)
SELECT files, CASE WHEN r IS NULL THEN 'left' ELSE 'right' END AS side, count(*) AS n_lines,
       min(coalesce(l, r)) AS first_line
FROM pairs WHERE l IS NULL OR r IS NULL GROUP BY ALL""",
    "pair_len_filter": f"""
WITH {_PAIR_TOKENS}
SELECT conv_id, turn, '<s> ' || array_to_string(s, ' ') || ' </s>' AS src,
       '<s> ' || array_to_string(g, ' ') || ' </s>' AS tgt
FROM t WHERE len(s) BETWEEN 1 AND 58 AND len(g) BETWEEN 1 AND 58""",
    "clean_corpus": f"""
WITH {_PAIR_TOKENS}, n AS (SELECT conv_id, turn, CAST(len(s) AS BIGINT) AS n_src, CAST(len(g) AS BIGINT) AS n_tgt FROM t)
SELECT * FROM n WHERE n_src BETWEEN 1 AND 200 AND n_tgt BETWEEN 1 AND 200
  AND greatest(n_src, n_tgt) / least(n_src, n_tgt) <= 9""",
    "parse_ready": f"""
WITH {views.LINES} SELECT doc_id, line_no, line FROM v_lines WHERE len({views.tokens('line')}) <= 80""",
    "crop_tokens": f"""
WITH {views.LINES}, t AS (SELECT doc_id, line_no, ({views.tokens('line')})[1:150] AS t FROM v_lines)
SELECT doc_id, line_no, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS cropped FROM t""",
    "hash_codes": """
WITH c AS (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding) AS x FROM embeddings)
SELECT vec_id, CAST(pos // 8 AS INTEGER) AS part, string_agg(CASE WHEN x > 0 THEN '1' ELSE '0' END, '' ORDER BY pos) AS bits,
       CAST(sum(CASE WHEN x > 0 THEN 1 << (pos % 8) ELSE 0 END) AS BIGINT) AS code
FROM c GROUP BY vec_id, pos // 8""",
    "hash_projected": f"WITH {views.SCORES} SELECT vec_id, code FROM v_codes",
    "saturating_sigmoid": """
SELECT vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS pos,
       round(least(greatest(1.2 / (1 + exp(-CAST(unnest(embedding) AS DOUBLE))) - 0.1, 0.0), 1.0), 6) AS soft_bit
FROM embeddings""",
    "code_export": f"WITH {_CODED} SELECT line_no, src || chr(9) || cfg || chr(9) || code AS line FROM v_export",
    "make_target": f"WITH {_CODED}, {_MERGED} SELECT * FROM merged",
    "unlabelled_rows": f"""
WITH {_CODED}
SELECT line_no, l.src FROM v_labelling l LEFT JOIN coded c ON c.src = trim(l.src) AND c.cfg = l.cfg WHERE c.src IS NULL""",
    "tripled_pairs": f"""
WITH {views.PAIRS}
, numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no FROM v_pairs)
SELECT conv_id, turn, pos, line_no * 3 + pos AS out_no, src, tgt FROM numbered, range(0, 3) AS r(pos)""",
}
