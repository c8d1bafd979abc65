"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

DataFrame operations only. The steps are: targets per source (``fill_targets``), integer
quotas of blocks per source and, of these, per source and shard (``apportion``), and a seeded
choice of that many blocks among those of the source in the shard (``mix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import WORD, n_words
from weft.operators.ordering import sliced
from weft.session import freeze

WEIGHTS = (5.0, 2.0, 1.0)
# Words the whole mix takes, and words a source gives at most, in units of what there is.
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 128
# Words and rows of a shard, over all its sources: what the largest window holds.
SHARD_WORDS = 4_000_000
SHARD_ROWS = 20_000
# Blocks of a source that get a quota together, at least: a thin source joins its shards up to that.
PART_BLOCKS = 1_000
# Primes that make the seeded multipliers: some is no divisor of a number of blocks, as their product is beyond it.
PRIMES = (1009, 1013, 1019, 1021, 1031, 1033, 1039, 1049, 1051, 1061, 1063, 1069, 1087, 1091, 1093, 1097)


def fill_targets(sources: DataFrame, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Add ``target`` to ``sources(source, source_size, weight)``, one row a source.

    ``share`` of all sizes is dealt by weight; a target stops at ``repeats`` times its
    source's size and the excess is dealt again by weight until none is above. The sources
    that stop are those of the smallest size per weight, so with the sources in that order
    the level of the rest is a running sum away. Sums are taken in cumulative windows
    over the table of sources, which has one narrow row a source.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "source")
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(repeats))
    level = (F.col("__all") * F.lit(float(share)) - F.col("__full")) / (F.col("__weights") - F.col("__gone"))
    return (
        sources.withColumn("__all", F.sum("source_size").over(whole))
        .withColumn("__weights", F.sum("weight").over(whole))
        .withColumn("__full", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("__gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("__level", level)
        # The first source that stays below its stop sets the level of all that follow.
        .withColumn("__level", F.when(F.col("__level") * F.col("weight") <= cap, F.col("__level")))
        .withColumn(
            "__level", F.first("__level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        )
        .withColumn("target", F.coalesce(F.col("__level") * F.col("weight"), cap))
        .drop("__all", "__weights", "__full", "__gone", "__level")
    )


def apportion(parties: DataFrame, group: list[str], order: list[str], votes: str, seats: str, name: str) -> DataFrame:
    """Add ``name``: how many of the ``seats`` of its group each party gets by its ``votes``.

    Sainte-Laguë: the seats go to the highest quotients votes / (2 i + 1); ties go by
    ``order``. Quotients above the divisor votes_of_group / (seats - parties / 2) surely
    get a seat and those below votes_of_group / (seats + parties / 2) none, so only the
    quotients between, about two a party, are listed and ranked.
    """
    by = Window.partitionBy(*group)
    total, n = F.sum(votes).over(by), F.count(F.lit(1)).over(by)
    sure = F.greatest(
        F.lit(0.0),
        F.when(F.col(seats) > F.col("__n") / 2, F.col(votes) * (F.col(seats) - F.col("__n") / 2) / F.col("__total"))
        .otherwise(F.lit(0.0)),
    )
    most = F.col(votes) * (F.col(seats) + F.col("__n") / 2) / F.col("__total")
    bounds = (
        parties.withColumn("__total", total)
        .withColumn("__n", n)
        # A party of quotient q over the divisor has round(q) seats; one less and one more for rounding errors.
        .withColumn(
            "__sure",
            F.when(F.col(votes) > 0, F.greatest(F.lit(0), F.floor(sure + 0.5) - 1)).otherwise(0).cast("bigint"),
        )
        .withColumn("__most", F.when(F.col(votes) > 0, F.floor(most + 0.5) + 1).otherwise(0).cast("bigint"))
        .withColumn("__left", F.col(seats) - F.sum("__sure").over(by))
    )
    key = [*group, *order]
    listed = bounds.filter("__most > __sure").select(
        *key, votes, "__left", F.explode(F.expr("sequence(__sure, __most - 1)")).alias("__i")
    )
    rank = F.row_number().over(
        Window.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("__i") + 1)), *order, "__i")
    )
    won = (
        listed.withColumn("__rank", rank)
        .filter(F.col("__rank") <= F.col("__left"))
        .groupBy(*[F.col(k).alias(f"__{k}") for k in key])
        .agg(F.count(F.lit(1)).alias("__won"))
    )
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    condition = same[0]
    for clause in same[1:]:
        condition = condition & clause
    return (
        bounds.join(won, condition, "left")
        .withColumn(name, F.col("__sure") + F.coalesce(F.col("__won"), F.lit(0)))
        .drop("__total", "__n", "__sure", "__most", "__left", "__won", *[f"__{k}" for k in key])
    )


def _content(docs: DataFrame, columns: list[str]) -> list[Column]:
    """What a hash of some columns takes: each with its null mark, as hashes skip nulls."""
    parts = []
    for c in columns:
        value, kind = F.col(f"`{c}`"), docs.schema[c].dataType.simpleString()
        # Maps and variants have no hash of their own.
        parts += [value.isNull(), F.to_json(F.struct(value)) if "map<" in kind or "variant" in kind else value]
    return parts


def _numbered_equals(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``__rank``: the number from 0, by ``order``, of a row among the rows of its ``key``.

    Rows are sorted only if a key repeats. The sort cuts a key of very many rows into slices;
    what earlier slices hold of it is added.
    """
    if rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").isEmpty():
        return rows.withColumn("__rank", F.lit(0).cast("bigint"))
    cut = sliced(rows, [F.col(key), *[F.col(c) for c in order]])
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first key of a slice can go on from an earlier one: one row a slice at most.
    starts = (
        cut.groupBy(key, "slice").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.sum("__n").over(earlier))
        .filter("__before > 0")
        .select(key, "slice", "__before")
    )
    inside = F.row_number().over(Window.partitionBy(key, "slice").orderBy("__place")) - 1
    return (
        cut.withColumn("__rank", inside)
        .join(F.broadcast(starts), [key, "slice"], "left")
        .withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0)))
        .drop("slice", "__place", "__before")
    )


def _parts(rows: DataFrame, quotas: DataFrame, shards: int, block_words: int, part_blocks: int, repeats: int, seed: int) -> DataFrame:
    """``source, shard`` of every cell, where it starts in its part, and what the part gives.

    The shards of a source follow each other from one that its name gives; a part is all that
    start in one stretch of ``part_blocks`` blocks, so a source with more than that in a shard
    has a part per shard, and only its thin shards are put together.
    """
    turn = F.pmod(F.col("shard") - F.pmod(F.xxhash64("source"), F.lit(shards)), F.lit(shards))
    earlier = Window.partitionBy("source").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.groupBy("source", "shard")
        .agg(F.sum("size").alias("words"))
        .withColumn("turn", turn)
        .withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .withColumn("part", F.expr(f"before div {block_words * part_blocks}"))
    )
    parts = cells.groupBy("source", "part").agg(F.sum("words").alias("words"), F.min("before").alias("start"))
    wanted = parts.alias("p").join(quotas.alias("q"), F.col("p.source").eqNullSafe(F.col("q.source"))).select("p.*", "source_size", "target", "quota")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)).cast("bigint")
    mixed = F.xxhash64("source", "part", F.lit(seed))
    factors = F.array(
        *[
            F.when((F.pmod(F.shiftright("__hash", k), F.lit(2)) == 1) & (F.col("blocks") % p != 0), F.lit(p)).otherwise(F.lit(1)).cast("bigint")
            for k, p in enumerate(PRIMES)
        ]
    )
    given = (
        apportion(wanted, ["source"], ["part"], "words", "quota", "part_quota")
        .withColumn("due", F.least(F.col("part_quota") * block_words, F.col("words") * repeats).cast("bigint"))
        .withColumn("rounds", F.when(F.col("words") > 0, F.expr("due div words")).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest_words", F.col("due") - F.col("rounds") * F.col("words"))
        .withColumn("blocks", blocks)
        .withColumn("short", F.col("blocks") * block_words - F.col("words"))
        # Block b is the (factor * b + shift) mod blocks-th in the seeded order.
        .withColumn("__hash", mixed)
        .withColumn("factor", F.aggregate(factors, F.lit(1).cast("bigint"), lambda x, p: x * p % F.col("blocks")))
        .withColumn("shift", F.pmod(F.shiftright("__hash", len(PRIMES)), F.col("blocks")))
        .withColumn("last_rank", F.pmod(F.col("factor") * (F.col("blocks") - 1) + F.col("shift"), F.col("blocks")))
        .drop("__hash")
    )
    return (
        cells.select("source", "shard", "part", "before").alias("c")
        .join(given.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")) & (F.col("c.part") == F.col("g.part")))
        .select("c.source", "c.shard", "c.part", (F.col("before") - F.col("start")).alias("cell_start"),
                "source_size", "target", "words", "part_quota", "rounds", "rest_words", "blocks", "short", "factor", "shift", "last_rank")
    )


def _chosen(block_words: int) -> Column:
    """``from, to`` of each run of words that the chosen blocks take of a document at ``start`` of its part."""

    def piece(b: Column) -> Column:
        rank = F.pmod(F.col("factor") * b + F.col("shift"), F.col("blocks"))
        # The last block is shorter, so what follows it in the order starts earlier.
        before = rank * block_words - F.when(rank > F.col("last_rank"), F.col("short")).otherwise(F.lit(0))
        size = F.lit(block_words) - F.when(b == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(0))
        taken = F.greatest(F.least(F.col("rest_words") - before, size), F.lit(0))
        return F.struct(
            (F.greatest(b * block_words, F.col("start")) - F.col("start")).alias("from"),
            (F.least(b * block_words + taken, F.col("start") + F.col("size")) - F.col("start")).alias("to"),
        )

    numbers = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return F.when(
        (F.col("size") > 0) & (F.col("rest_words") > 0),
        F.filter(F.transform(numbers, piece), lambda r: r["from"] < r["to"]),
    ).otherwise(none)


def shares(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    part_blocks: int = PART_BLOCKS,
    seed: int = 0,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    row: str | None = None,
    rest: str | None = None,
) -> DataFrame:
    """What ``mix`` returns, and ``part, start, words, part_quota, pieces`` besides.

    ``start`` is the place of a document's first word in its part of the source, ``words`` and
    ``part_quota`` are the part's words and blocks; ``pieces`` holds ``from, to`` of the
    document's words that the chosen blocks take beyond the whole rounds.
    """
    rows = freeze(
        docs.select(
            F.col(id).alias("doc_id"),
            F.col(source).alias("source"),
            n_words(F.col(text)).alias("size"),
            F.xxhash64(*_content(docs, [id, source, text]), F.lit(seed)).alias("__content"),
            (F.lit(0) if rest is None else F.col(rest)).cast("bigint").alias("__rest"),
            (F.monotonically_increasing_id() if row is None else F.col(row)).alias("__row"),
        )
    )
    totals = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-totals.words // shard_words), -(-totals.n // SHARD_ROWS))

    in_turn = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = fill_targets(
        rows.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(in_turn, place % len(weights) + 1)),
        share,
        repeats,
    )
    blocks_wanted = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("bigint")
    quotas = apportion(
        sources.withColumn("__all", F.lit(0)).withColumn("__blocks", blocks_wanted),
        ["__all"], ["source"], "target", "__blocks", "quota",
    ).select("source", "source_size", "target", "quota")

    # Ids and sizes part what a hash may not; the row number only orders equal rows.
    ties = ["doc_id", "source", "size", "__rest", "__row"]
    rows = freeze(
        _numbered_equals(rows, "__content", ties)
        .withColumn("__order", F.xxhash64("__content", "__rank"))
        .withColumn("shard", F.pmod(F.xxhash64("__order"), F.lit(shards)).cast("int"))
    )
    run = Window.partitionBy("source", "shard").orderBy("__order", *ties)
    # One row a source and shard, read by the join below; written, as its quotas take several groupings.
    cells = freeze(_parts(rows, freeze(quotas), shards, block_words, part_blocks, repeats, seed))
    joined = (
        rows.withColumn("__end", F.sum("size").over(run))
        .alias("r")
        .join(
            cells.alias("c"),
            F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.shard") == F.col("c.shard")),
        )
        .select("r.*", *[F.col(f"c.{c}") for c in cells.columns if c not in ("source", "shard")])
        .withColumn("start", F.col("cell_start") + F.col("__end") - F.col("size"))
        .withColumn("pieces", _chosen(block_words))
    )
    extra = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, r: n + r["to"] - r["from"])
    return joined.withColumn("extra", extra).select(
        "doc_id", "size", "source", "source_size", "target", "shard", "rounds", "extra",
        (F.col("size") * F.col("rounds") + F.col("extra")).alias("taken"),
        "part", "start", "words", "part_quota", "pieces", "__row",
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source, source_size, target, shard, rounds, extra, taken`` of every row.

    Sources in code point order, null last and a source like any other, get the ``weights``
    in turn. Documents are dealt to shards by a hash. Sources get quotas of blocks of
    ``block_words`` by their targets, by Sainte-Laguë; the quota of a source is dealt again, by
    the same rule, to its shards by their words (thin shards of a source are put together until
    they have ``part_blocks`` blocks, so that a quota of whole blocks fits them). The documents
    of a source in a shard, in a seeded order, are a run of words cut into blocks; of these
    the quota takes all in whole ``rounds`` and the rest by a seeded order of the blocks. The
    short last block counts at its size: the last block taken gives its first words only, so
    that a shard gives its due to the word. A due is at most ``repeats`` times the words there.

    ``extra`` words of a document lie in the chosen blocks; ``taken`` is the words in all,
    repeats included; it never exceeds ``repeats`` times the size.

    Shard and order come from a hash of id, source, text and seed, so they are the same in
    every layout of the rows. Rows equal in these are documents of their own and are told
    apart by their number among equals, by ``rest`` (a column that hashes what else a row
    holds) and then ``row``, which is the place in the read where it is not given.

    A null or empty text has size 0 and nothing is taken from it. An empty table gives no
    rows. Other columns are not read. ``options``: those of ``shares``.
    """
    return shares(docs, **options).drop("part", "start", "words", "part_quota", "pieces")


def mixed_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", chars: str | None = "n_chars", row: Column | None = None, **options
) -> DataFrame:
    """The mix itself: a row for each time a document is taken, all its columns in place.

    A document that is taken in part gives its words in the chosen blocks, with the white
    space before them; ``chars`` names a column with the text's length that follows it. What is
    not taken is left out. ``row`` names a row of ``docs`` for good, however it is read, and joins it to
    its share; without it the documents are written once with a row number. The text is shuffled once.

    Null and empty texts, which have no words to take, go; equal rows are documents of their
    own; other columns are copied, whatever their names but ``__row`` and ``__rest``.
    """
    number = F.monotonically_increasing_id() if row is None else row
    kept = docs.select("*", F.xxhash64(*_content(docs, docs.columns)).alias("__rest"), number.alias("__row"))
    if row is None:
        kept = freeze(kept)
    found = shares(kept, id=id, text=text, row="__row", rest="__rest", **options).filter("taken > 0").select(
        "__row", F.col("rounds").alias("__rounds"), F.col("extra").alias("__extra"), F.col("size").alias("__size"), F.col("pieces").alias("__pieces")
    )
    # The words travel in the accumulator, so they are cut once.
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    part = F.when(
        F.col("__extra") < F.col("__size"),
        F.array_join(
            F.flatten(
                F.aggregate(
                    F.array(words), F.array().cast("array<array<string>>"),
                    lambda _, w: F.transform("__pieces", lambda r: F.slice(w, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int"))),
                )
            ),
            "",
        ),
    ).otherwise(F.col(text))
    copies = F.concat(
        F.array_repeat(F.col(text), F.col("__rounds").cast("int")),
        F.when(F.col("__extra") > 0, F.array(part)).otherwise(F.array().cast("array<string>")),
    )
    out = kept.join(found, "__row").withColumn(text, F.explode(copies))
    if chars in docs.columns:
        out = out.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType))
    return out.select(*docs.columns)
