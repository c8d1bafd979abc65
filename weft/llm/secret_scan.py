"""Secret scans: a trigram index narrows each rule to candidates, which are then verified.

DataFrame operations only; regular expressions are read on the driver, once a rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import trigrams

# Documents of an index block: the longest postings list.
BLOCK_DOCUMENTS = 8192
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose ``group`` has ``least`` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# A private key: the marker, then all up to the end marker if that is the next one; without it,
# header lines and the run of base64 lines, of which the last may be short. Line ends may be
# escaped, quoted or prefixed. Repeated groups are possessive: Java walks these without recursion.
_KEY = r"[A-Z ]{0,30}PRIVATE KEY-----"
_BREAK = r"""(?:[\s>|#*"',;+]|\\+[rnt])*+"""
_BASE64_LINES = (
    rf"(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+"
    rf"(?:(?:{_BREAK}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[ \t\r]*+\n|\s*+(?![\s\S])|[\\\"']))?+)?+"
)
PRIVATE_KEY = rf"-----BEGIN {_KEY}(?:(?>[\s\S]*?-----)END {_KEY}|{_BASE64_LINES})"

# The forms of the secrets. The first three are the base rules. The bound of a
# run's length stands in the expression where that finds the same matches.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", PRIVATE_KEY),
)
BASE = ("assign", "access", "hex")


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """``trigram, block, docs``: of each wanted trigram, the sorted keys of the texts that have it.

    ``docs(key, text)``. Blocks by a hash of the key bound the lists, however common a
    trigram is; a key that repeats is listed once.
    """
    blocks = max(1, -(-docs.count() // BLOCK_DOCUMENTS))
    low = F.lower("text")
    has = F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.col("low"), t))
    return (
        docs.select("key", low.alias("low"))
        .select("key", F.explode(has).alias("trigram"))
        .groupBy("trigram", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"))
        .agg(F.array_sort(F.collect_set("key")).alias("docs"))
    )


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``key, kinds``: the rules whose trigram query a text satisfies; full-scan rules left out."""
    spark = docs.sparkSession
    asked = [
        (rule.kind, number, len(clause), t)
        for rule in rules
        for number, clause in enumerate(trigrams.query(rule.regex) or [])
        for t in sorted(clause)
    ]
    if not asked:
        return spark.createDataFrame([], "key long, kinds array<string>")
    # As many rows as the rules have trigrams.
    clauses = spark.createDataFrame(asked, "kind string, clause int, needs int, trigram string")
    index = postings(docs, sorted({a[-1] for a in asked}))
    lists = F.col("lists")
    shortest_first = F.array_sort(F.collect_list(F.struct(F.size("docs").alias("n"), "docs")))
    return (
        index.join(F.broadcast(clauses), "trigram")
        .groupBy("kind", "clause", "needs", "block")
        .agg(F.count(F.lit(1)).alias("has"), shortest_first.alias("lists"))
        .filter("has = needs")
        .select(
            "kind",
            F.explode(
                F.aggregate(
                    F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))),
                    F.element_at(lists, 1).getField("docs"),
                    lambda found, more: F.array_intersect(found, more.getField("docs")),
                )
            ).alias("key"),
        )
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _spans(text: Column, matches: Column, rule: Rule, at: int) -> Column:
    """``start, place, end, kind`` of each match: the text between matches gives the offsets."""
    gaps = F.transform(F.split(text, rule.regex, -1), lambda gap: F.length(gap))
    sizes = F.transform(matches, lambda m: F.length(m))
    counted = sizes if rule.group == 0 else F.transform(
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), lambda m: F.length(m)
    )
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), sizes.alias("size"), counted.alias("counted"))
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,counted:int>>")
    walked = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("pos"), none.alias("out")),
        lambda acc, r: F.struct(
            (acc["pos"] + r["gap"] + r["size"]).alias("pos"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["pos"] + r["gap"]).alias("start"), F.lit(at).alias("place"),
                        (acc["pos"] + r["gap"] + r["size"]).alias("end"), F.lit(rule.kind).alias("kind"),
                        r["counted"].alias("counted"),
                    )
                ),
            ),
        ),
        lambda acc: acc["out"],
    )
    return F.filter(walked, lambda s: s["counted"] >= rule.least)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, spans``: every row of ``docs`` as a struct with all secrets of its whole text.

    A rule with mandatory trigrams is verified on the texts that its trigram query leaves,
    found by intersecting the postings of the index; any other rule is run on all texts.
    Matches are leftmost and do not overlap within a kind; those whose counted group is too
    short are dropped. ``spans`` holds ``start, place, end, kind, counted`` by start, then by the
    order of the rules; offsets count code points, the end is exclusive.

    A null text counts as empty. Rows with one id share their candidates, and so do all rows
    without id, which changes no result, as all are verified. An empty table gives no rows.
    Columns of any name are kept inside ``doc``.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col(id).cast("bigint"), F.lit(0)).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    found = candidates(rows.select("key", "text"), rules)
    out = rows.join(found, "key", "left")
    for at, rule in enumerate(rules):
        matches = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0))
        if trigrams.query(rule.regex) is not None:
            matches = F.when(F.array_contains("kinds", rule.kind), matches)
        out = out.withColumn(f"m{at}", matches)
    spans = [
        F.when(F.size(f"m{at}") > 0, _spans(F.col("text"), F.col(f"m{at}"), rule, at)) for at, rule in enumerate(rules)
    ]
    return out.select("doc", F.array_sort(F.flatten(F.array_compact(F.array(*spans)))).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of a scan with the base rules."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    count = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in BASE]
    return found.select(
        F.col("doc.doc_id").cast("bigint").alias("doc_id"), *count,
        F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mask))
        return F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"),
            F.when(s["start"] >= acc["pos"], before).otherwise(acc["out"]).alias("out"),
        )

    return F.when(
        F.size(spans) > 0,
        F.aggregate(
            spans, start, step,
            lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))),
        ),
    ).otherwise(text)


def mask_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret in the text masked and the text's length in ``chars`` renewed.

    All rows stay. A text without secrets, null included, is left as it is.
    """
    found = scan(docs, rules, id, text).withColumn("clean", masked(F.col(f"doc.`{text}`"), F.col("spans")))
    columns = []
    for c in docs.columns:
        column = F.col(f"doc.`{c}`")
        if c == text:
            column = F.col("clean")
        elif c == chars:
            column = F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[c].dataType)).otherwise(column)
        columns.append(column.alias(c))
    return found.select(*columns)
