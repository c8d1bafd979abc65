"""The registered queries of the package, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import (
    discriminant, jaccard, language, mixing, packing, quality, secret_scan, sharding, spelling, suffix_dedup, topk, trie, warc,
)
from weft.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return language.identify(table(spark, sf_dir, "documents"), held_out)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), warc.new_folder(spark))
    return warc.read_warc(manifest, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), clean=False).drop("clean")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered_turns(table(spark, sf_dir, "conversations"))
    own = F.col("conv_id")
    return trie.prefix_trie(*trie.rebuild(turns, own - own % 100, F.crc32(own.cast("string")) % 6, most=5))


def op13_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return discriminant.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), terms AS (
  SELECT vec_id, unnest(w) AS w, unnest(range(len(w))) AS d FROM v
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score
  FROM terms q JOIN terms c ON q.d = c.d AND c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
) WHERE rank <= 10
"""

# CRC-32 byte by byte, from a table of its 256 steps.
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(v ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, j: xor(x >> 1, (x & 1) * 3988292384)) AS v FROM range(256) t(i)
  )
), runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
    FROM documents
  ) WHERE length(w) >= 7 GROUP BY ALL
), bytes AS (
  SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda s:
    CASE WHEN ord(s) < 128 THEN [ord(s)::BIGINT] ELSE [(192 + ord(s) // 64)::BIGINT, (128 + ord(s) % 64)::BIGINT] END)) AS b FROM runs
), hashed AS (
  SELECT w, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, crcs[xor(c & 255, x) + 1]))) AS h
  FROM bytes, steps
), counts AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), shorter AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM counts)
), pairs AS (
  SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT s.word, c.word, c.n FROM shorter s JOIN counts c ON c.word = s.rest
  UNION
  SELECT c.word, s.word, s.n FROM shorter s JOIN counts c ON c.word = s.rest
), near AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM pairs GROUP BY word
), known AS (
  SELECT counts.word, counts.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM counts LEFT JOIN near USING (word)
), chain AS (
  SELECT word, word AS top FROM known UNION ALL SELECT chain.word, known.form FROM chain JOIN known ON known.word = chain.top WHERE form IS NOT NULL
)
SELECT known.word, form, top AS root, n, n_near, form_n FROM known JOIN (
  SELECT chain.word, top FROM chain JOIN known ON known.word = chain.top WHERE known.form IS NULL
) AS ends ON ends.word = known.word
"""

# CRC-32 is folded from the digits of the id, bit by bit.
OP12_SQL = """
WITH ids AS (
  SELECT DISTINCT conv_id AS c, conv_id - conv_id % 100 AS base FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT c, base, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))
  )) % 6 AS h FROM ids
), said AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))
  ) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT heads.c, p, r, x FROM heads JOIN said ON said.c = base AND p < h
  UNION ALL
  SELECT heads.c, p - h + least(h, coalesce(n, 0)), r, x FROM heads JOIN said ON said.c = heads.c AND p >= h
  LEFT JOIN (SELECT c, count(*) AS n FROM said GROUP BY c) AS sizes ON sizes.c = base
), path AS (
  SELECT c, 0 AS d, '' AS node, NULL AS parent, 0 AS chars FROM heads
  UNION ALL
  SELECT c, d, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY d), ''), chars FROM (
    SELECT c, p + 1 AS d, length(x) AS chars,
      string_agg(sha256(length(r)::VARCHAR || ':' || r || x), '') OVER (PARTITION BY c ORDER BY p) AS node FROM turns
  )
), nodes AS (
  SELECT node, d, any_value(parent) AS parent, min(c) AS c, count(*) AS n, max(chars) AS chars FROM path GROUP BY node, d
), ends AS (
  SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest FROM (
    SELECT c, max_by(node, d) AS node FROM path GROUP BY c
  ) GROUP BY node
), kids AS (
  SELECT parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY parent
), trees AS (
  SELECT up.node, sum((v.n - 1) * v.chars) AS saved, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM nodes v JOIN path up ON up.c = v.c AND up.d <= v.d LEFT JOIN kids ON kids.node = v.node GROUP BY up.node
)
SELECT u.c AS conv_id, u.d::BIGINT AS depth, above.c AS parent_conv_id, u.n AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM nodes u JOIN trees ON trees.node = u.node LEFT JOIN kids ON kids.node = u.node LEFT JOIN ends ON ends.node = u.node
LEFT JOIN nodes above ON above.node = u.parent
"""

QUERIES = {
    "op1_language": op1_language,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_jaccard": op4_jaccard,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_topk": op10_topk,
    "op11_spelling": op11_spelling,
    "op12_trie": op12_trie,
    "op13_discriminant": op13_discriminant,
}

ORACLE = {"op10_topk": OP10_SQL, "op11_spelling": OP11_SQL, "op12_trie": OP12_SQL}
