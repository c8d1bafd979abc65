"""Lines, tokens and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import vocabulary as op
from weft.plans import views
from weft.session import freeze
from weft.sources import tables

VOCAB_LIMIT = 3000
LINE = ["doc_id", "line_no"]


def lines_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.numbered(spark, sf_dir).select("line_no", "doc_id", "line")


def tokens_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.split_ws(text.strip("line"))
    return tables.lines(spark, sf_dir).select(
        "doc_id",
        "line_no",
        F.size(tokens).cast("bigint").alias("n_tokens"),
        F.array_join(tokens, " ").alias("tokens"),
    )


def corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, line_no, pos, token``: single-space tokens of stripped lines."""
    return tables.lines(spark, sf_dir).select(
        "doc_id", "lang", "line_no", F.posexplode(text.split_space(text.strip("line"))).alias("pos", "token")
    )


def vocab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.token_counts(corpus_tokens(spark, sf_dir))


def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.build_vocab(corpus_tokens(spark, sf_dir))


def vocab_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.build_vocab(
        corpus_tokens(spark, sf_dir), limit=VOCAB_LIMIT, order=["doc_id", "line_no", "pos"]
    )


def vocab_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.frequent(op.token_counts(corpus_tokens(spark, sf_dir)), 10)


def vocab_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = tables.lines(spark, sf_dir).select(
        F.explode(text.split_chars(text.strip("line"))).alias("token")
    )
    return op.build_vocab(chars)


def vocab_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as the given list, then sources and languages added where absent."""
    docs = tables.table(spark, sf_dir, "documents")
    base = docs.groupBy(F.col("lang").alias("token")).agg(F.min("doc_id").alias("seen"))
    more = docs.select(F.explode(F.array("lang", "source")).alias("token"), F.col("doc_id").alias("seen"))
    merged = op.add_tokens(op.set_vocab(base, "seen"), more, "seen")
    return merged.select("id", "token")


def vocab_marian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.build_vocab(corpus_tokens(spark, sf_dir), specials=op.DECODER_SPECIALS).select("id", "token")


def _stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines(spark, sf_dir).select("doc_id", "line_no", text.split_ws(text.strip("line")).alias("tokens"))


def encode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = op.encode(_stripped(spark, sf_dir), vocab_build(spark, sf_dir), LINE)
    return coded.select(*LINE, F.array_join("ids", " ").alias("ids"))


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decode of encode with a vocabulary of the words of ten and more: those come back, the others as UNK.

    No dictionary is broadcast here, whatever its size.
    """
    counts = op.frequent(op.token_counts(corpus_tokens(spark, sf_dir)), 10)
    vocab = freeze(op.vocab_of_counts(counts))
    coded = op.encode(_stripped(spark, sf_dir), vocab, LINE, broadcast_bytes=0)
    back = op.decode(coded, vocab, LINE, broadcast_bytes=0)
    return back.select(*LINE, F.array_join("tokens", " ").alias("tokens"))


def oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: document tokens that the vocabulary of the conversations lacks."""
    turns = tables.table(spark, sf_dir, "conversations").select(
        F.explode(text.split_ws("text")).alias("token")
    )
    counts = op.token_counts(corpus_tokens(spark, sf_dir), "lang")
    return op.oov_rate(counts, op.token_counts(turns), "lang")


QUERIES = {
    "lines_numbered": lines_numbered,
    "tokens_ws": tokens_ws,
    "vocab_counts": vocab_counts,
    "vocab_build": vocab_build,
    "vocab_limit": vocab_limit,
    "vocab_threshold": vocab_threshold,
    "vocab_chars": vocab_chars,
    "vocab_merge": vocab_merge,
    "vocab_marian": vocab_marian,
    "encode_tokens": encode_tokens,
    "decode_roundtrip": decode_roundtrip,
    "oov_rate": oov_rate,
}

_STRIPPED = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
TOKENS = (
    views.LINES
    + f""",
v_tokens AS (
  SELECT doc_id, lang, line_no, unnest(range(0, len(t))) AS pos, unnest(t) AS token
  FROM (SELECT *, string_split({_STRIPPED}, ' ') AS t FROM v_lines)
),
v_counts AS (SELECT token, count(*) AS cnt, min((doc_id, line_no, pos)) AS first FROM v_tokens GROUP BY token)"""
)


def _specials(tokens: list[str], with_count: bool = True) -> str:
    count = ", 0 AS cnt" if with_count else ""
    return " UNION ALL ".join(f"SELECT {i} AS id, '{t}' AS token{count}" for i, t in enumerate(tokens))


_WS = f"""v_lookup AS (SELECT token, max(id) AS id FROM v_vocab GROUP BY token),
v_ws AS (
  SELECT doc_id, line_no, unnest(range(0, len(t))) AS pos, unnest(t) AS token
  FROM (SELECT *, {views.tokens('line')} AS t FROM v_lines)
)"""


def _vocab(counts: str) -> str:
    return f"""{TOKENS},
v_vocab AS (
  {_specials(op.SPECIALS)} UNION ALL
  SELECT row_number() OVER (ORDER BY cnt DESC, token) + 3 AS id, token, cnt FROM ({counts})
),
{_WS}"""


VOCAB = _vocab("SELECT token, cnt FROM v_counts")
LIMITED = _vocab(f"SELECT token, cnt FROM v_counts ORDER BY cnt DESC, first LIMIT {VOCAB_LIMIT - 4}")
FREQUENT = _vocab("SELECT token, cnt FROM v_counts WHERE cnt >= 10")

ORACLE = {
    "lines_numbered": f"""
WITH {views.LINES}
SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_no, doc_id, line FROM v_lines""",
    "tokens_ws": f"""
WITH {views.LINES}, t AS (SELECT doc_id, line_no, {views.tokens('line')} AS t FROM v_lines)
SELECT doc_id, line_no, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM t""",
    "vocab_counts": f"WITH {TOKENS} SELECT token, cnt FROM v_counts",
    "vocab_build": f"""
WITH {TOKENS}
{_specials(op.SPECIALS)} UNION ALL
SELECT row_number() OVER (ORDER BY cnt DESC, token) + 3 AS id, token, cnt FROM v_counts""",
    "vocab_limit": f"WITH {LIMITED} SELECT * FROM v_vocab",
    "vocab_threshold": f"WITH {TOKENS} SELECT token, cnt FROM v_counts WHERE cnt >= 10",
    "vocab_chars": f"""
WITH {views.LINES},
chars AS (SELECT unnest(string_split({_STRIPPED}, '')) AS token FROM v_lines WHERE {_STRIPPED} <> ''),
counts AS (SELECT token, count(*) AS cnt FROM chars GROUP BY token)
{_specials(op.SPECIALS)} UNION ALL
SELECT row_number() OVER (ORDER BY cnt DESC, token) + 3 AS id, token, cnt FROM counts""",
    "vocab_merge": f"""
WITH langs AS (SELECT lang AS token, min(doc_id) AS seen FROM documents GROUP BY lang),
extra AS (SELECT source AS token, min(doc_id) AS seen FROM documents
          WHERE source NOT IN (SELECT token FROM langs) GROUP BY source),
every AS (SELECT 0 AS part, * FROM langs UNION ALL SELECT 1, * FROM extra)
{_specials(op.SPECIALS, False)} UNION ALL
SELECT row_number() OVER (ORDER BY part, seen, token) + 3 AS id, token FROM every""",
    "vocab_marian": f"""
WITH {TOKENS}
{_specials(op.DECODER_SPECIALS, False)} UNION ALL
SELECT row_number() OVER (ORDER BY cnt DESC, token) + 1 AS id, token FROM v_counts""",
    "encode_tokens": f"""
WITH {VOCAB}
SELECT l.doc_id, l.line_no, coalesce(string_agg(CAST(coalesce(k.id, 3) AS VARCHAR), ' ' ORDER BY w.pos)
                                     FILTER (w.pos IS NOT NULL), '') AS ids
FROM v_lines l LEFT JOIN v_ws w ON w.doc_id = l.doc_id AND w.line_no = l.line_no
LEFT JOIN v_lookup k ON k.token = w.token GROUP BY l.doc_id, l.line_no""",
    "decode_roundtrip": f"""
WITH {FREQUENT}
SELECT l.doc_id, l.line_no, coalesce(string_agg(CASE WHEN k.id IS NULL THEN 'UNK' ELSE w.token END, ' ' ORDER BY w.pos)
                                     FILTER (w.pos IS NOT NULL), '') AS tokens
FROM v_lines l LEFT JOIN v_ws w ON w.doc_id = l.doc_id AND w.line_no = l.line_no
LEFT JOIN v_lookup k ON k.token = w.token GROUP BY l.doc_id, l.line_no""",
    "oov_rate": f"""
WITH {TOKENS},
known AS (SELECT DISTINCT unnest({views.tokens('text')}) AS token FROM conversations),
per_lang AS (SELECT lang, token, count(*) AS cnt FROM v_tokens GROUP BY lang, token)
SELECT lang, CAST(sum(cnt) AS BIGINT) AS n_tokens,
       CAST(coalesce(sum(cnt) FILTER (token NOT IN (SELECT token FROM known)), 0) AS BIGINT) AS n_oov,
       count(*) AS n_types, count(*) FILTER (token NOT IN (SELECT token FROM known)) AS n_oov_types,
       round(n_oov / n_tokens, 6) AS oov_rate
FROM per_lang GROUP BY lang""",
}
