"""Metric tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import metrics as op
from weft.operators import projection
from weft.operators.batching import train_valid_split
from weft.plans import views
from weft.sources import tables

BLEU_EVENT = "purchase"
LOSS_EVENT = "view"
FOREST = 128
SEED = 3


def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means per user and event type; one type stands for BLEU, one for the loss."""
    means = op.epoch_means(tables.metric_log(spark, sf_dir))
    return op.with_mix(means, BLEU_EVENT, LOSS_EVENT).select(
        "run", F.col("epoch").cast("string").alias("epoch"), "name", F.round("value", 6).alias("value")
    )


def metric_best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.metric_log(spark, sf_dir).select("run", "name", "ts", "event_id", "value")
    return op.best_so_far(log, ["run", "name"], ["ts", "event_id"]).select(
        "event_id", "run", "name", "best_before", "improved"
    )


def label_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.label_eval(tables.class_scores(spark, sf_dir)).select(
        "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_nll", 6).alias("mean_nll")
    )


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label over the vectors whose first component is positive."""
    vecs = tables.table(spark, sf_dir, "embeddings").withColumn("mask", F.get("embedding", F.lit(0)) > 0)
    pooled = projection.mean_pool(vecs, ["label"], "embedding", "mask")
    return pooled.select("label", F.posexplode("pooled").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    items = tables.table(spark, sf_dir, "lineitem")
    counts = {
        "blocks": docs.agg(F.count_distinct("source").alias("n")),
        "pairs": tables.pairs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")),
        "trees": items.agg(F.count_distinct("l_orderkey").alias("n")),
        "batches": docs.agg(F.ceil(F.count(F.lit(1)) / FOREST).alias("n")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(what).alias("what"), "n") for what, df in counts.items()])


def valid_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrapped lines of the validation split in order, and of all lines in no order."""
    lines = tables.lines(spark, sf_dir).select(
        "doc_id", "line_no", F.array_join(text.wrap(text.split_ws("line")), " ").alias("text")
    )
    valid = train_valid_split(lines, ["doc_id", "line_no"], seed=SEED).filter("split = 'valid'")
    ordered = op.ordered_fingerprint(valid, "idx", "text").withColumn("kind", F.lit("valid"))
    whole = op.set_fingerprint(lines, "text")
    return ordered.unionByName(
        whole.select("n", F.col("fingerprint").cast("string"), F.lit("all").alias("kind"))
    )


QUERIES = {
    "metric_rollup": metric_rollup,
    "metric_best_so_far": metric_best_so_far,
    "label_eval": label_eval,
    "mean_pool": mean_pool,
    "corpus_counts": corpus_counts,
    "valid_fingerprint": valid_fingerprint,
}

ORACLE = {
    "metric_rollup": f"""
WITH m AS (SELECT user_id AS run, CAST(CAST(ts AS DATE) AS VARCHAR) AS epoch, event_type AS name, avg(value) AS value FROM events GROUP BY ALL)
SELECT run, epoch, name, round(CASE WHEN name = '{BLEU_EVENT}' THEN -value ELSE value END, 6) AS value FROM m
UNION ALL
SELECT b.run, b.epoch, 'mix', round(l.value / 0.02 - b.value, 6) FROM m b JOIN m l ON b.run = l.run AND b.epoch = l.epoch
WHERE b.name = '{BLEU_EVENT}' AND l.name = '{LOSS_EVENT}'""",
    "metric_best_so_far": """
WITH b AS (
  SELECT event_id, user_id AS run, event_type AS name, value,
         least(65535.0, coalesce(min(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 65535.0)) AS best_before FROM events)
SELECT event_id, run, name, CAST(best_before AS DOUBLE) AS best_before, value <= best_before AS improved FROM b""",
    "label_eval": f"""
WITH {views.SCORES},
s AS (SELECT e.vec_id, any_value(e.label) AS label, list(s ORDER BY bit) AS s FROM v_scores JOIN embeddings e USING (vec_id) GROUP BY e.vec_id)
SELECT count(*) AS n, round(avg(CASE WHEN list_position(s, list_max(s)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg(ln(list_sum(list_transform(s, lambda x: exp(x)))) - s[label + 1]), 6) AS mean_nll FROM s""",
    "mean_pool": """
WITH x AS (SELECT label, CAST(unnest(range(0, 64)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x
           FROM embeddings WHERE embedding[1] > 0)
SELECT label, pos, round(sum(x) / (count(*) + 1e-7), 6) AS mean FROM x GROUP BY label, pos""",
    "corpus_counts": f"""
WITH {views.PAIRS}
SELECT 'blocks' AS what, count(DISTINCT source) AS n FROM documents
UNION ALL SELECT 'pairs', count(*) FROM v_pairs
UNION ALL SELECT 'trees', count(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'batches', (count(*) + {FOREST - 1}) // {FOREST} FROM documents""",
    "valid_fingerprint": f"""
WITH {views.LINES},
t AS (SELECT doc_id, line_no, trim('<s> ' || array_to_string({views.tokens('line')}, ' '))|| ' </s>' AS text FROM v_lines),
v AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':' || line_no || ':{SEED}'), doc_id, line_no) - 1 AS idx FROM t)
SELECT count(*) AS n, right(sha1(string_agg(text, chr(10) ORDER BY idx)), 8) AS fingerprint, 'valid' AS kind FROM v WHERE idx < 1000
UNION ALL
SELECT count(*), CAST(sum(CAST('0x' || substr(md5('=' || text), 1, 15) AS BIGINT)) AS VARCHAR), 'all' FROM t""",
}
