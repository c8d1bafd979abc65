"""n-best selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import selection as op
from weft.plans import views
from weft.sources import tables


def nbest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.parse_nbest(tables.nbest(spark, sf_dir))


def diverse_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.diverse_top(nbest_parse(spark, sf_dir)).select(
        "block", "rank", "pos", "code", "sent", "n_kept"
    )


def diverse_top3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.diverse_top(nbest_parse(spark, sf_dir)).select(
        "block", "pos", op.triple_line().alias("line")
    )


def nbest_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.nbest_top(nbest_parse(spark, sf_dir)).select("block", "rank", "pos", "code", "sent")


def block_code_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.block_code_stats(nbest_parse(spark, sf_dir))


def block_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "lang")
    runs = op.blocks_by_run(docs, "lang", "doc_id")
    return runs.groupBy("block_no").agg(
        F.first("lang").alias("lang"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")
    )


def diverse_new_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that the diverse choice of a block has and its plain top three lacks."""
    nbest = nbest_parse(spark, sf_dir)
    chosen = op.diverse_top(nbest).filter("code IS NOT NULL")
    return op.new_codes(op.nbest_top(nbest), chosen)


QUERIES = {
    "nbest_parse": nbest_parse,
    "diverse_top3": diverse_top3,
    "diverse_top3_lines": diverse_top3_lines,
    "nbest_top3": nbest_top3,
    "block_code_stats": block_code_stats,
    "block_islands": block_islands,
    "diverse_new_codes": diverse_new_codes,
}

# First occurrence of each code, then fill up by preference: set logic, no ranking by code.
_DIVERSE = f"""
WITH {views.NBEST},
firsts AS (SELECT block, code, min(rank) AS rank FROM v_nbest WHERE code IS NOT NULL GROUP BY block, code),
preference AS (
  SELECT n.*, CASE WHEN n.code IS NULL THEN 2
                   WHEN n.rank IN (SELECT f.rank FROM firsts f WHERE f.block = n.block) THEN 0
                   ELSE 1 END AS tier
  FROM v_nbest n
),
best AS (SELECT block, list_slice(list(rank ORDER BY tier, rank), 1, 3) AS ranks FROM preference GROUP BY block),
kept AS (
  SELECT n.block, n.rank, CAST(list_position(list_sort(b.ranks), n.rank) - 1 AS BIGINT) AS pos, n.code, n.sent,
         len(b.ranks) AS n_kept
  FROM v_nbest n JOIN best b ON b.block = n.block AND list_contains(b.ranks, n.rank)
)
"""

ORACLE = {
    "nbest_parse": f"WITH {views.NBEST} SELECT block, rank, code, sent, p1, p2 FROM v_nbest",
    "diverse_top3": _DIVERSE + "SELECT * FROM kept",
    "diverse_top3_lines": _DIVERSE
    + "SELECT block, pos, coalesce(code, 'NULL') || sent AS line FROM kept",
    "nbest_top3": f"""
WITH {views.NBEST}, placed AS (
  SELECT block, rank, row_number() OVER (PARTITION BY block ORDER BY rank) - 1 AS pos, code, sent FROM v_nbest)
SELECT * FROM placed WHERE pos < 3""",
    "block_code_stats": f"""
WITH {views.NBEST}
SELECT block, count(*) AS n_rows, count(*) - count(code) AS n_without_code, count(DISTINCT code) AS n_codes
FROM v_nbest GROUP BY block""",
    "diverse_new_codes": _DIVERSE
    + """, top AS (SELECT block, code, row_number() OVER (PARTITION BY block ORDER BY rank) AS place FROM v_nbest)
SELECT block, code FROM kept WHERE code IS NOT NULL
EXCEPT SELECT block, code FROM top WHERE place <= 3""",
    "block_islands": """
WITH marked AS (
  SELECT doc_id, lang, CASE WHEN lang IS NOT DISTINCT FROM lag(lang) OVER (ORDER BY doc_id)
                             AND row_number() OVER (ORDER BY doc_id) > 1 THEN 0 ELSE 1 END AS starts
  FROM documents),
numbered AS (SELECT *, sum(starts) OVER (ORDER BY doc_id) - 1 AS block_no FROM marked)
SELECT CAST(block_no AS BIGINT) AS block_no, min(lang) AS lang, min(doc_id) AS first_id, count(*) AS n_rows
FROM numbered GROUP BY block_no""",
}
