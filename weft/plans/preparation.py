"""Corpus preparation: punctuation, casing, subwords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import casing, subwords
from weft.operators import jobs
from weft.operators.vocabulary import token_counts
from weft.plans import views
from weft.plans.vocabulary import corpus_tokens
from weft.session import freeze
from weft.sources import tables

LINE = ["doc_id", "line_no"]


def normalise_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines(spark, sf_dir).select(
        *LINE, text.tokenise(text.normalise("line", "lang"), "lang").alias("text")
    )


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lines(spark, sf_dir).select(*LINE, text.split_ws("line").alias("tokens"))


def truecase_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casing.truecase_model(_tokens(spark, sf_dir))


def truecase_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    cased = casing.truecase(_tokens(spark, sf_dir), truecase_model(spark, sf_dir))
    return cased.select(*LINE, F.array_join("tokens", " ").alias("text"))


def bpe_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.learn_bpe(token_counts(corpus_tokens(spark, sf_dir)))


def bpe_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus in pieces; merged pieces seen fewer than ten times are split again."""
    # Read by the merges and by the counts of pieces.
    types = freeze(token_counts(corpus_tokens(spark, sf_dir).filter("token <> ''")))
    merges = subwords.learn_bpe(types)
    pieces = subwords.piece_counts(types, merges)
    coded = subwords.apply_bpe(_tokens(spark, sf_dir), merges, LINE, pieces=pieces, threshold=10)
    return coded.select(*LINE, F.array_join("tokens", " ").alias("text"))


def corpus_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation pairs through the whole preparation."""
    pairs = tables.pairs(spark, sf_dir)
    return jobs.prepare_pairs(pairs, ["conv_id", "turn"], "en", "en").pairs


QUERIES = {
    "normalise_punct": normalise_punct,
    "truecase_model": truecase_model,
    "truecase_apply": truecase_apply,
    "bpe_learn": bpe_learn,
    "bpe_apply": bpe_apply,
    "corpus_prep": corpus_prep,
}


def _sub(sql: str, pattern: str, by: str) -> str:
    return f"regexp_replace({sql}, '{pattern}', '{by}', 'g')"


def _quoted(value: str) -> str:
    if value in ("\r", "\u00a0"):
        return f"chr({ord(value)})"
    return "'" + value.replace("'", "''") + "'"


def _by_lang(sql: str, pattern: str, by: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN lang = '{lang}' THEN {_sub(sql, pattern, to)}" for lang, to in by.items())
    return f"CASE {cases} ELSE {_sub(sql, pattern, default)} END"


def _steps() -> list[tuple[str, str]]:
    """Common table expressions, one per rule, each over the column ``x`` of the one before."""
    rules = [_by_lang("x", "([0-9])\u00a0([0-9])", {lang: "\\1,\\2" for lang in text.DECIMAL_COMMA}, "\\1.\\2")]
    rules += [f"replace(x, {_quoted(a)}, {_quoted(b)})" for a, b in text.PLAIN_CHARACTERS + text.PLAIN_PUNCTUATION]
    rules += [_sub("x", a, b) for a, b in (
        (" +", " "), ("\\) ([.!:?;,])", ")\\1"), ("\\( ", "("), (" \\)", ")"), (" ([:;,?!])", "\\1"),
    )]
    rules.append(f"CASE WHEN lang = 'en' THEN {_sub('x', chr(34) + '([,.]+)', chr(92) + '1' + chr(34))} ELSE x END")
    rules.append("' ' || trim(x) || ' '")
    rules.append(_sub("x", "([^\\p{L}\\p{N}\\s.,''-])", " \\1 "))
    rules += 2 * [_sub("x", "([\\p{L}\\p{N}])-([\\p{L}\\p{N}])", "\\1 @-@ \\2")]
    rules += [_sub("x", "([^0-9])([.,])", "\\1 \\2 "), _sub("x", "([.,])([^0-9])", " \\1 \\2")]
    rules += 2 * [_by_lang("x", "(\\p{L})''(\\p{L})", {"en": "\\1 ''\\2", "fr": "\\1'' \\2"}, "\\1 '' \\2")]
    rules.append(f"trim({_sub('x', chr(92) + 's+', ' ')})")
    steps = [("s0", "SELECT doc_id, line_no, lang, line AS x FROM v_lines")]
    for i, rule in enumerate(rules, 1):
        steps.append((f"s{i}", f"SELECT doc_id, line_no, lang, {rule} AS x FROM s{i - 1}"))
    return steps


_CTES = ",\n".join(f"{name} AS ({sql})" for name, sql in _steps())

_MODEL = f"""{views.LINES},
t AS (SELECT doc_id, line_no, {views.tokens('line')} AS t FROM v_lines),
later AS (SELECT unnest(t[2:]) AS token FROM t),
counts AS (SELECT lower(token) AS lower, token, count(*) AS cnt FROM later GROUP BY ALL),
model AS (SELECT lower, token, cnt FROM counts
          QUALIFY row_number() OVER (PARTITION BY lower ORDER BY cnt DESC, token) = 1)"""

ORACLE = {
    "normalise_punct": f"WITH {views.LINES}, {_CTES} SELECT doc_id, line_no, x AS text FROM {_steps()[-1][0]}",
    "truecase_model": f"WITH {_MODEL} SELECT * FROM model",
    "truecase_apply": f"""
WITH {_MODEL}
SELECT doc_id, line_no, array_to_string(CASE WHEN m.token IS NULL THEN t ELSE list_concat([m.token], t[2:]) END, ' ') AS text
FROM t LEFT JOIN model m ON m.lower = lower(t[1])""",
}
