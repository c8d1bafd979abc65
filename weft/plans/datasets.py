"""Dataset preparation: shards, batches, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import alignment, jobs, loading
from weft.operators import batching as op
from weft.operators.ordering import ranked, split_file_parts
from weft.plans import views
from weft.plans.trees import FULL
from weft.plans.vocabulary import VOCAB, lines_numbered, vocab_build
from weft.session import freeze
from weft.sources import tables

PARTS = 3
SHARD = 1000
BATCH = 128
BUDGET = 4096
PAIR_BUDGET = 512
WORDS_AND_MARKS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
VALID = 50
DATAPOINTS = 2000
CAP = 60
KEEP = 500
SEED = 3


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, doc_id, line``: all lines of all documents."""
    return lines_numbered(spark, sf_dir)


def corpus_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    total = corpus.agg(F.count(F.lit(1))).scalar()
    return split_file_parts(corpus, PARTS, total).filter("part is not null").select("part", "line_no", "doc_id")


def _loaded(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        *more,
        "line_no",
        F.array_join("ids", " ").alias("ids"),
        F.array_join(F.transform("nodes", lambda n: n["dec_label"]), " ").alias("labels"),
    )


def loader_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a tree, as ids and node labels."""
    sources, trees, _ = tables.labelling(spark, sf_dir)
    return _loaded(loading.loader_rows(sources, trees, vocab_build(spark, sf_dir), max_tokens=CAP, depth_limit=2))


def loader_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines by the limit of data points, filtered, padded to their number, shuffled and split."""
    sources, trees, _ = tables.labelling(spark, sf_dir)
    rows = loading.loader_dataset(
        sources, trees, vocab_build(spark, sf_dir), n_valid=VALID, seed=SEED, max_tokens=CAP, depth_limit=2, limit_datapoints=DATAPOINTS
    )
    return _loaded(rows, "stands_for", "idx", "split")


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_cap(_corpus(spark, sf_dir).withColumn("tokens", text.split_ws("line")), "tokens", CAP)


def loader_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.truncate(_short(spark, sf_dir), KEEP).select("line_no", "doc_id")


def bootstrap_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    survivors = _short(spark, sf_dir).select("line_no", "doc_id")
    return op.bootstrap_pad(survivors, _corpus(spark, sf_dir), seed=SEED)


def train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.lines(spark, sf_dir).select("doc_id", "line_no")
    return op.train_valid_split(lines, ["doc_id", "line_no"], batch_size=BATCH, seed=SEED)


def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.fixed_batches(_corpus(spark, sf_dir).select("line_no", "doc_id"), BATCH, "line_no", drop_last=True)


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of two sides: words of a line, and words and marks apart."""
    parts = F.regexp_count("line", F.lit(WORDS_AND_MARKS))
    return _corpus(spark, sf_dir).select(
        "line_no", (F.size(text.split_ws("line")) + 2).alias("n_src"), (parts + 2).alias("n_tgt")
    )


def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of the whole corpus, made of slices far smaller than it."""
    return op.token_batches(_lengths(spark, sf_dir), BUDGET, slice_rows=SHARD)


def batch_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches in a seeded shuffle, and back again from their places."""
    batches = freeze(token_batches(spark, sf_dir).groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_lines")))
    placed = op.shuffle_batches(batches, seed=SEED)
    return op.restore_batches(placed, seed=SEED, out="restored")


def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training data of the conversation pairs: filter, split, token batches of each part, their shuffle."""
    pairs = ranked(tables.pairs(spark, sf_dir), [F.col("conv_id"), F.col("turn")], "line_no")
    made = jobs.training_data(pairs.select("line_no", "src", "tgt"), n_valid=VALID, batch_size=PAIR_BUDGET, batch_type="token", seed=SEED)
    return made.select("line_no", "idx", "split", "batch_id", "batch_place", "place")


def batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = op.fixed_batches(_lengths(spark, sf_dir), BATCH, "line_no")
    return op.order_in_batch(batched, "n_src").select("batch_id", "line_no", "place")


def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the tokens of each line as ids, padded per batch."""
    lines = _corpus(spark, sf_dir).withColumn(
        "ids", F.transform(text.split_ws("line"), lambda t: F.length(t).cast("bigint"))
    )
    return op.pad_batch(op.fixed_batches(lines, BATCH, "line_no")).select(
        "batch_id", "line_no", F.array_join("ids", " ").alias("ids")
    )


def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.shard(lines_numbered(spark, sf_dir).select("line_no"), SHARD)


def shard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.shard_summary(op.shard(lines_numbered(spark, sf_dir), SHARD))


def _plain_e(lines: list[str]) -> list[str]:
    return [line.replace("e", "3") for line in lines]


def sharded_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.sharded_map(lines_numbered(spark, sf_dir), _plain_e, lines=SHARD)


QUERIES = {
    "corpus_part": corpus_part,
    "loader_rows": loader_rows,
    "loader_dataset": loader_dataset,
    "loader_truncate": loader_truncate,
    "bootstrap_pad": bootstrap_pad,
    "train_valid_split": train_valid_split,
    "fixed_batches": fixed_batches,
    "token_batches": token_batches,
    "batch_shuffle": batch_shuffle,
    "training_batches": training_batches,
    "batch_order": batch_order,
    "padded_batches": padded_batches,
    "shard_assign": shard_assign,
    "shard_summary": shard_summary,
    "sharded_map": sharded_map,
}

_DOCS = f"""{views.NUMBERED},
short AS (SELECT * FROM v_numbered WHERE len({views.tokens('line')}) <= {CAP})"""

_LENGTHS = f"""{views.NUMBERED},
lengths AS (
  SELECT line_no, len({views.tokens('line')}) + 2 AS n_src, len(regexp_extract_all(line, '{WORDS_AND_MARKS}')) + 2 AS n_tgt FROM v_numbered)"""

_ROWS = f"""{VOCAB}, {FULL}, {_DOCS},
o AS (SELECT line_no AS k, row_number() OVER (ORDER BY line_no) - 1 AS tree_no FROM v_orders),
said AS (SELECT line_no, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM (SELECT line_no, {views.tokens('line')} AS t FROM short)),
coded AS (
  SELECT line_no, string_agg(CAST(coalesce(x.id, 3) AS VARCHAR), ' ' ORDER BY pos) AS ids
  FROM said LEFT JOIN v_lookup x ON x.token = said.token GROUP BY line_no),
labelled AS (SELECT line_no AS k, string_agg(dec_label, ' ' ORDER BY node_id) AS labels FROM v_nodes GROUP BY line_no),
loaded AS (
  SELECT s.line_no, coalesce(c.ids, '') AS ids, labels FROM short s JOIN o ON o.tree_no = s.line_no % (SELECT count(*) FROM o)
  JOIN labelled USING (k) LEFT JOIN coded c ON c.line_no = s.line_no)"""


def _scan(rows: str, budget: int, more: str = "") -> str:
    """Token batches ``scan`` of ``rows(i, len)``, numbered from 0 for each ``more``: from row to row."""
    also = f", {more}" if more else ""
    same = f" AND l.{more} = s.{more}" if more else ""
    over = f"greatest(longest, len) * (n + 1) > {budget}"
    return f"""
scan AS (
  SELECT i, CASE WHEN len > {budget} THEN 1 ELSE 0 END AS batch_no, 1 AS n, len AS longest{also} FROM {rows} WHERE i = 0
  UNION ALL
  SELECT l.i, CASE WHEN {over} THEN batch_no + 1 ELSE batch_no END, CASE WHEN {over} THEN 1 ELSE n + 1 END,
         CASE WHEN {over} THEN len ELSE greatest(longest, len) END{', l.' + more if more else ''}
  FROM scan s JOIN {rows} l ON l.i = s.i + 1{same})"""


def _permuted(source: str, index: str, n: str, seed: str) -> str:
    """``walk``: rows of ``source`` with ``l, r`` after turns 1 to 4, again while they lie beyond ``n``."""

    def number(k: str, x: str) -> str:
        return f"CAST('0x' || substr(md5({seed} || ':' || {k} || ':' || {x}), 1, 15) AS BIGINT)"

    k = "(turn % 4 + 1)"
    return f"""
sized AS (SELECT *, {n} AS n, greatest(1, CAST(ceil(sqrt({n})) AS BIGINT)) AS a FROM {source}),
walk AS (
  SELECT *, (n + a - 1) // a AS b, {index} % a AS l, {index} // a AS r, 0 AS turn FROM sized
  UNION ALL
  SELECT * REPLACE (CASE WHEN {k} % 2 = 1 THEN (l + {number(k, 'r')}) % a ELSE l END AS l,
                    CASE WHEN {k} % 2 = 0 THEN (r + {number(k, 'l')}) % b ELSE r END AS r, {k} AS turn)
  FROM walk WHERE turn < 4 OR l + a * r >= n)"""


ORACLE = {
    "corpus_part": f"""
WITH {views.NUMBERED}, s AS (SELECT count(*) // {PARTS} AS size FROM v_numbered)
SELECT line_no // size AS part, line_no, doc_id FROM v_numbered, s WHERE line_no < {PARTS} * size""",
    "loader_rows": f"WITH {_ROWS} SELECT * FROM loaded",
    "loader_dataset": f"""
WITH {_ROWS},
first AS (SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS r FROM loaded WHERE line_no < {DATAPOINTS}),
padded AS (
  SELECT line_no AS stands_for, line_no, ids, labels FROM first
  UNION ALL
  SELECT v.line_no, f.line_no, f.ids, f.labels FROM v_numbered v JOIN first f
  ON f.r = CAST('0x' || substr(md5(v.line_no || ':{SEED}'), 1, 15) AS BIGINT) % (SELECT count(*) FROM first)
  WHERE v.line_no < {DATAPOINTS} AND v.line_no NOT IN (SELECT line_no FROM first)),
placed AS (SELECT *, row_number() OVER (ORDER BY md5(stands_for || ':{SEED}'), stands_for) - 1 AS idx FROM padded)
SELECT *, CASE WHEN idx < {VALID} THEN 'valid' ELSE 'train' END AS split FROM placed""",
    "loader_truncate": f"WITH {_DOCS} SELECT line_no, doc_id FROM short ORDER BY line_no LIMIT {KEEP}",
    "bootstrap_pad": f"""
WITH {_DOCS}, placed AS (SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS r FROM short),
lost AS (SELECT line_no AS stands_for FROM v_numbered WHERE line_no NOT IN (SELECT line_no FROM short))
SELECT line_no, doc_id, line_no AS stands_for FROM short
UNION ALL
SELECT p.line_no, doc_id, stands_for FROM lost JOIN placed p
ON p.r = CAST('0x' || substr(md5(stands_for || ':{SEED}'), 1, 15) AS BIGINT) % (SELECT count(*) FROM short)""",
    "train_valid_split": f"""
WITH {views.LINES},
placed AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY md5(doc_id || ':' || line_no || ':{SEED}'), doc_id, line_no) - 1 AS idx
           FROM v_lines)
SELECT doc_id, line_no, idx, CASE WHEN idx < {op.VALID_ROWS} THEN 'valid' ELSE 'train' END AS split FROM placed
WHERE idx < {op.VALID_ROWS} + greatest((SELECT count(*) FROM placed) - {op.VALID_ROWS}, 0) // {BATCH} * {BATCH}""",
    "fixed_batches": f"""
WITH {views.NUMBERED}
SELECT line_no, doc_id, line_no // {BATCH} AS batch_id, line_no % {BATCH} AS pos_in_batch FROM v_numbered
WHERE line_no < (SELECT count(*) FROM v_numbered) // {BATCH} * {BATCH}""",
    "token_batches": f"""
WITH RECURSIVE {_LENGTHS}, l AS MATERIALIZED (SELECT line_no AS i, greatest(n_src, n_tgt) AS len FROM lengths), {_scan('l', BUDGET)}
SELECT i AS line_no, CAST(batch_no AS BIGINT) AS batch_no FROM scan""",
    "batch_shuffle": f"""
WITH RECURSIVE {_LENGTHS}, l AS MATERIALIZED (SELECT line_no AS i, greatest(n_src, n_tgt) AS len FROM lengths), {_scan('l', BUDGET)},
batches AS (SELECT CAST(batch_no AS BIGINT) AS batch_no, count(*) AS n_lines FROM scan GROUP BY batch_no),
{_permuted('batches', 'batch_no', '(SELECT max(batch_no) + 1 FROM batches)', f"'{SEED}'")}
SELECT batch_no, n_lines, CAST(l + a * r AS BIGINT) AS place, batch_no AS restored FROM walk WHERE turn = 4 AND l + a * r < n""",
    "training_batches": f"""
WITH RECURSIVE {views.PAIRS},
kept AS (
  SELECT line_no, len(s) + 2 AS n_src, len(g) + 2 AS n_tgt FROM (
    SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_no, {views.tokens('src')} AS s, {views.tokens('tgt')} AS g FROM v_pairs)
  WHERE len(s) BETWEEN 1 AND 58 AND len(g) BETWEEN 1 AND 58),
placed AS (SELECT *, row_number() OVER (ORDER BY md5(line_no || ':{SEED}'), line_no) - 1 AS idx FROM kept),
parts AS MATERIALIZED (
  SELECT line_no, idx, n_src, CASE WHEN idx < {VALID} THEN 'valid' ELSE 'train' END AS split,
         CASE WHEN idx < {VALID} THEN idx ELSE idx - {VALID} END AS i, greatest(n_src, n_tgt) AS len FROM placed),
{_scan('parts', PAIR_BUDGET, 'split')},
batches AS (SELECT split, CAST(batch_no AS BIGINT) AS batch_id, max(batch_no) OVER (PARTITION BY split) + 1 AS n_all FROM (SELECT DISTINCT split, batch_no FROM scan)),
{_permuted('batches', 'batch_id', 'n_all', f"'{SEED}:' || split")}
SELECT line_no, idx, p.split, w.batch_id, CAST(w.l + w.a * w.r AS BIGINT) AS batch_place,
       row_number() OVER (PARTITION BY p.split, w.batch_id ORDER BY n_src, line_no) - 1 AS place
FROM parts p JOIN scan s ON s.split = p.split AND s.i = p.i JOIN walk w ON w.split = p.split AND w.batch_id = s.batch_no
WHERE turn = 4 AND w.l + w.a * w.r < w.n""",
    "batch_order": f"""
WITH {_LENGTHS}
SELECT line_no // {BATCH} AS batch_id, line_no,
       row_number() OVER (PARTITION BY line_no // {BATCH} ORDER BY n_src, line_no) - 1 AS place FROM lengths""",
    "padded_batches": f"""
WITH {views.NUMBERED}, t AS (SELECT line_no // {BATCH} AS batch_id, line_no, {views.tokens('line')} AS t FROM v_numbered),
m AS (SELECT batch_id, max(len(t)) AS m FROM t GROUP BY batch_id)
SELECT batch_id, line_no, array_to_string(list_transform(range(1, m + 1),
         lambda i: CASE WHEN i <= len(t) THEN length(t[i]) ELSE 0 END), ' ') AS ids
FROM t JOIN m USING (batch_id)""",
    "shard_assign": f"""
WITH {views.NUMBERED} SELECT line_no, line_no // {SHARD} AS shard_id, line_no % {SHARD} AS line_in_shard FROM v_numbered""",
    "shard_summary": f"""
WITH {views.NUMBERED}
SELECT line_no // {SHARD} AS shard_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars,
       CASE WHEN line_no // {SHARD} < 10 THEN '0' ELSE '' END || line_no // {SHARD} AS name
FROM v_numbered GROUP BY line_no // {SHARD}""",
    "sharded_map": f"WITH {views.NUMBERED} SELECT line_no, replace(line, 'e', '3') AS output FROM v_numbered",
}
