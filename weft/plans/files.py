"""Files: what the writers commit below the checkpoint folder, read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import strip
from weft.operators import batching, jobs, selection
from weft.operators.ordering import ranked
from weft.operators.vocabulary import token_counts
from weft.plans import alignment, bleu, datasets, views, vocabulary
from weft.plans import selection as nbest
from weft.session import ensure_checkpoint_dir
from weft.sources import corpus, sinks, tables
from weft.sources.commit import commit_tables, verify

SAMPLE = 40


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/weft-files-{uuid.uuid4().hex}"


def _in_order(df: DataFrame, order: list[str], value: str) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(value).alias("value"))


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as text files, numbered again from the files, and with their line ends counted."""
    path = _folder(spark)
    sinks.write_lines(vocabulary.lines_numbered(spark, sf_dir), path, "line")
    verify(spark, path, corpus.LINES)
    ends = corpus.count_terminated(spark, corpus.committed_files(spark, path, corpus.LINES))
    return corpus.read_committed(spark, path).select("line_no", "text", F.lit(ends).cast("bigint").alias("n_ends"))


def file_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as compressed files, spread after numbering."""
    path = _folder(spark)
    _in_order(vocabulary.lines_numbered(spark, sf_dir), ["line_no"], "line").write.option("compression", "gzip").text(path)
    return corpus.read_lines(spark, path, partitions=16).select("line_no", "text")


def file_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n-best files to code-diverse triples: blocks are runs of equal ids, ranks are places in the files."""
    path, out = _folder(spark), _folder(spark)
    raw = tables.nbest(spark, sf_dir).withColumn("block", F.substring_index("value", "|||", 1))
    commit_tables(path, {corpus.LINES: _in_order(raw, ["block", "rank"], "value")}, text=[corpus.LINES])
    jobs.select_diverse(spark, corpus.committed_files(spark, path, corpus.LINES), out)
    return corpus.read_committed(spark, out + sinks.TRIPLES_SUFFIX).select("line_no", "text")


def file_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation pairs as two tab-separated fields."""
    path = _folder(spark)
    pairs = ranked(tables.pairs(spark, sf_dir), [F.col("conv_id"), F.col("turn")], "line_no")
    _in_order(pairs.withColumn("line", F.concat_ws("\t", "src", "tgt")), ["line_no"], "line").write.text(path)
    return corpus.read_tsv_pairs(spark, path)


def file_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees as one line each, aligned by line number."""
    path = _folder(spark)
    _in_order(tables.numbered_trees(spark, sf_dir), ["tree_no"], "cfg").write.text(path)
    return corpus.read_trees(spark, path)


def file_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved vocabulary beside the same one from a text file of tokens in id order."""
    path, text = _folder(spark), _folder(spark)
    sinks.save_vocab(vocabulary.vocab_build(spark, sf_dir), path)
    saved = corpus.load_vocab(spark, path)
    _in_order(saved, ["id"], "token").write.text(text)
    listed = corpus.load_vocab(spark, text, text=True).select("id", F.col("token").alias("listed"))
    return saved.join(listed, "id").select("id", "token", "cnt", "listed")


def file_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the tokens in one field of a tab-separated file."""
    path = _folder(spark)
    lines = tables.numbered(spark, sf_dir).withColumn("line", strip("line")).filter("line <> ''")
    _in_order(lines.withColumn("line", F.concat_ws("\t", "source", "line")), ["line_no"], "line").write.text(path)
    return token_counts(corpus.read_tokens(spark, path, field=1))


def file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code export."""
    path = _folder(spark)
    sinks.write_codes(alignment._exported(spark, sf_dir), path)
    return corpus.read_committed(spark, path).select("line_no", "text")


def file_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged target."""
    path = _folder(spark)
    sinks.write_target(alignment.make_target(spark, sf_dir), path)
    return corpus.read_committed(spark, path).select("line_no", "text")


def file_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept candidates, in the order of blocks and places."""
    path = _folder(spark)
    sinks.write_triples(selection.diverse_top(nbest.nbest_parse(spark, sf_dir)), path)
    return corpus.read_committed(spark, path + sinks.TRIPLES_SUFFIX).select("line_no", "text")


def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diversity job: its sample and both tables of scores, as written, and how many lines were scored."""
    path = _folder(spark)
    lexicon = bleu.lexicon(spark, sf_dir)
    jobs.diversity(bleu._lines(spark, sf_dir), SAMPLE, lexicon=lexicon, out=path)
    lines, words, tags = sinks.read_metrics(spark, path)
    scores = words.withColumn("kind", F.lit("words")).unionByName(tags.withColumn("kind", F.lit("tags")))
    counted = lines.groupBy(F.call_function("div", "line_no", F.lit(3)).alias("block")).agg(F.count(F.lit(1)).alias("n_lines"))
    return scores.join(counted, "block").select("kind", "block", "n_lines", *[F.round(f"bleu{i}", 6).alias(f"bleu{i}") for i in range(3)])


def file_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus in shards, listed by task, and put together again from their files."""
    path = _folder(spark)
    sinks.write_shards(batching.shard(vocabulary.lines_numbered(spark, sf_dir), datasets.SHARD), path, "line")
    listing = corpus.shard_manifest(spark, path)
    lines = corpus.read_committed(spark, path)
    names = listing.select("task_id", F.regexp_extract("path", "shard=([0-9]+)/", 1).alias("shard"))
    found = F.regexp_extract("file", "shard=([0-9]+)/", 1)
    return lines.withColumn("shard", found).join(names, "shard").select("task_id", "shard", "line_no", "text")


QUERIES = {
    "file_lines": file_lines,
    "file_gzip": file_gzip,
    "file_nbest": file_nbest,
    "file_tsv": file_tsv,
    "file_trees": file_trees,
    "file_vocab": file_vocab,
    "file_fields": file_fields,
    "file_codes": file_codes,
    "file_target": file_target,
    "file_triples": file_triples,
    "file_metrics": file_metrics,
    "file_shards": file_shards,
}


def _numbered(sql: str, order: str, value: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) - 1 AS line_no, {value} AS text FROM ({sql})"


_KEPT = nbest._DIVERSE + _numbered("SELECT block, pos, coalesce(code, 'NULL') || sent AS line FROM kept", "block, pos", "line")

ORACLE = {
    "file_lines": f"""
WITH {views.NUMBERED} SELECT line_no, line AS text, (SELECT count(*) FROM v_numbered) AS n_ends FROM v_numbered""",
    "file_gzip": f"WITH {views.NUMBERED} SELECT line_no, line AS text FROM v_numbered",
    # Files are in the order of the blocks, so runs of equal ids are the blocks.
    "file_nbest": _KEPT,
    "file_tsv": f"WITH {views.PAIRS} SELECT src, tgt FROM v_pairs",
    "file_trees": f"WITH {views.TREES} SELECT tree_no AS line_no, cfg FROM v_trees",
    "file_vocab": f"WITH {vocabulary.VOCAB} SELECT id, token, cnt, token AS listed FROM v_vocab",
    "file_fields": f"""
WITH {vocabulary.TOKENS}
SELECT token, count(*) AS cnt FROM v_tokens t JOIN v_lines l ON l.doc_id = t.doc_id AND l.line_no = t.line_no
WHERE trim(line) <> '' GROUP BY token""",
    "file_codes": f"WITH {alignment._CODED} "
    + _numbered("SELECT line_no AS n, src || chr(9) || cfg || chr(9) || code AS line FROM v_export", "n", "line"),
    "file_target": f"WITH {alignment._CODED}, {alignment._MERGED} SELECT line_no, line AS text FROM merged",
    "file_triples": _KEPT,
    "file_metrics": f"""
WITH {bleu._TAGS},
chosen AS (SELECT block FROM v_triples WHERE pos = 2 ORDER BY md5(block || ':{bleu.SEED}'), block LIMIT {SAMPLE}),
both_kinds AS (SELECT 'words' AS kind, block, pos, text FROM v_triples UNION ALL SELECT 'tags', block, pos, text FROM tagged),
sampled AS (SELECT * FROM both_kinds WHERE block IN (SELECT block FROM chosen)),
{bleu._self_bleu('sampled', 'kind, block')}
SELECT kind, block, CAST(3 AS BIGINT) AS n_lines, round(bleu0, 6) AS bleu0, round(bleu1, 6) AS bleu1, round(bleu2, 6) AS bleu2 FROM scores""",
    "file_shards": f"""
WITH {views.NUMBERED}
SELECT line_no // {datasets.SHARD} + 1 AS task_id, CASE WHEN line_no // {datasets.SHARD} < 10 THEN '0' ELSE '' END || line_no // {datasets.SHARD} AS shard,
       line_no, line AS text FROM v_numbered""",
}
