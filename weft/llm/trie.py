"""The trie of conversation prefixes by ROLLUP over positional turn-id columns.

A conversation is a row of BLOCK turn columns; a longer one goes on in further rows, each
keyed by the node that its turns before reach. One ROLLUP over the turn columns gives all
prefixes of all rows together, and ``grouping_id`` their lengths.

A turn is known by three numbers of 48 bits, hashed from its place and the SHA-256 of role
and text; a node by the sums of its turns' numbers (144 bits), so the key of any block is a
running sum and needs no walk along the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.ordering import sliced
from weft.operators.skew import join_unique
from weft.session import freeze

BLOCK = 8
WORDS = ("a", "b", "c")
MASK = (1 << 48) - 1
# Blocks of a conversation in one window, and conversations in one chunk of ids, as powers of two.
SPAN_BITS = 12


def _sum(column: Column | str) -> Column:
    """A sum modulo 2^48; its terms are below that, and fewer than 2^15 of them meet at once."""
    return F.sum(column).bitwiseAND(F.lit(MASK))


def numbered_turns(conversations: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, digest, chars`` of every turn, numbered from 0 in its conversation.

    Order: ``turn`` (null first), of equal ones by the SHA-256 of role and text; fully equal
    rows are turns of their own. Null role and text are empty; rows without a conversation
    id are left out. Texts are not shuffled. A conversation that holds many rows is cut into
    slices of the sort.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = conversations.filter(F.col(id).isNotNull()).select(
        F.col(id).cast("bigint").alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256)).alias("digest"),
        F.length(said).cast("bigint").alias("chars"),
    )
    cut = sliced(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")])
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy("conv_id", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(earlier))
        .filter("before > 0")
        .select("conv_id", "slice", "before")
    )
    inside = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy("__place")) - 1
    # One conversation at most goes on from one slice into the next: a row a slice.
    return (
        cut.withColumn("inside", inside)
        .join(F.broadcast(before), ["conv_id", "slice"], "left")
        .select("conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "chars")
    )


def rebuild(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: ``turns`` and the ids of all of them.

    The first ``head`` turns (``most`` at the most) of conversation ``base``, both
    expressions of ``conv_id``, then the own turns after the first ``head``. A base that is
    absent or shorter gives what it has; a conversation may be left without turns. A base
    should not serve a large share of all conversations.
    """
    turns = freeze(turns)
    ids = turns.select("conv_id").distinct().withColumn("head", head.cast("bigint")).withColumn("base", base)
    firsts = (
        turns.filter(F.col("pos") < most)
        .join(ids.select(F.col("base").alias("conv_id")).distinct(), "conv_id", "left_semi")
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("first"))
    )
    empty = F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>")
    headed = freeze(
        ids.join(firsts, "base", "left")
        .withColumn("first", F.coalesce("first", empty))
        .select("conv_id", "head", F.expr("slice(first, 1, cast(head as int))").alias("first"))
        .withColumn("got", F.size("first"))
    )
    own = join_unique(turns, headed.select("conv_id", "head", "got"), "conv_id", ["pos"], "inner")
    whole = headed.select("conv_id", F.inline("first")).unionByName(
        own.filter("pos >= head").select("conv_id", (F.col("pos") - F.col("head") + F.col("got")).alias("pos"), "digest", "chars")
    )
    return whole, headed.select("conv_id")


def _blocks(turns: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """``conv_id, block, t0, t1, ...``, block sums, and the key that the blocks before give."""
    words = [F.xxhash64(F.lit(k), "pos", "digest").bitwiseAND(F.lit(MASK)).alias(w) for k, w in enumerate(WORDS)]
    placed = turns.select(
        "conv_id", F.call_function("div", "pos", F.lit(block)).alias("block"), F.struct("pos", *words, "chars").alias("turn")
    )
    # A member without turns still is a row.
    none = members.select("conv_id", F.lit(0).cast("bigint").alias("block"), F.lit(None).cast(placed.schema["turn"].dataType).alias("turn"))
    # At most ``block`` turns a group.
    rows = (
        placed.unionByName(none)
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    )

    def total(name: str) -> Column:
        return F.aggregate("turns", F.lit(0).cast("bigint"), lambda s, t: s + t[name])

    rows = rows.select(
        "conv_id", "block",
        *[F.when(F.get("turns", F.lit(j)).isNotNull(), F.struct(*[F.get("turns", F.lit(j))[n].alias(n) for n in (*WORDS, "chars")])).alias(f"t{j}") for j in range(block)],
        *[total(w).bitwiseAND(F.lit(MASK)).alias(f"s{w}") for w in WORDS],
        total("chars").alias("schars"),
        F.shiftright("block", SPAN_BITS).alias("span"),
    )
    rows = freeze(rows)
    sums = [*[(f"s{w}", f"k{w}") for w in WORDS], ("schars", "kchars")]
    full = rows.groupBy("conv_id", "span").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s, _ in sums]).filter(
        F.col("n") == 1 << SPAN_BITS
    )
    # Only conversations of more than 2^SPAN_BITS blocks have any; a following span adds them.
    until = Window.partitionBy("conv_id").orderBy("span")
    starts = full.select("conv_id", (F.col("span") + 1).alias("span"), *[F.sum(s).over(until).alias(f"from_{k}") for s, k in sums])
    before = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    keyed = rows.join(starts, ["conv_id", "span"], "left")
    zero = F.lit(0).cast("bigint")
    for s, k in sums:
        key = F.coalesce(F.sum(s).over(before), zero) + F.coalesce(f"from_{k}", zero)
        keyed = keyed.withColumn(k, key if s == "schars" else key.bitwiseAND(F.lit(MASK)))
    return keyed.drop("span", *[f"from_{k}" for _, k in sums])


def _node(words: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.hex(w), 12, "0") for w in words])


def _rollup(rows: DataFrame, block: int, aggregates: str) -> DataFrame:
    """All prefixes of all blocks: ``node, parent, depth, before, chars`` and the aggregates.

    ``before``: characters above the node's last turn, which has ``chars``.
    """
    columns = [f"t{j}" for j in range(block)]
    found = rows.sparkSession.sql(
        f"SELECT block, ka, kb, kc, {', '.join(columns)}, {block} - bit_count(grouping_id()) AS level, "
        f"max(kchars) AS kchars, {aggregates} FROM {{rows}} GROUP BY block, ka, kb, kc, ROLLUP({', '.join(columns)})",
        rows=rows,
    )
    # Rows shorter than a level are no prefix of that length; a block's start is the end of the one before.
    last = F.array(*columns)[F.col("level") - 1]
    found = found.withColumn("last", F.when(F.col("level") > 0, last))
    found = found.filter("last IS NOT NULL OR (level = 0 AND block = 0)")
    zero = F.lit(0).cast("bigint")

    def path(name: str) -> Column:
        return sum((F.coalesce(F.col(c)[name], zero) for c in columns), zero)

    def own(name: str) -> Column:
        return F.coalesce(F.col("last")[name], zero)

    ends = [(F.col(f"k{w}") + path(w)) for w in WORDS]
    mask = F.lit(MASK)
    return found.select(
        _node([e.bitwiseAND(mask) for e in ends]).alias("node"),
        F.when(F.col("last").isNotNull(), _node([(e - own(w)).bitwiseAND(mask) for e, w in zip(ends, WORDS)])).alias("parent"),
        (F.col("block") * block + F.col("level")).alias("depth"),
        (F.col("kchars") + path("chars") - own("chars")).alias("before"),
        own("chars").alias("chars"),
        *[c for c in found.columns if c not in {"block", "ka", "kb", "kc", "level", "kchars", "last", *columns}],
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's joined chunks, which come in order; one hash state is held."""
    node, state, n = None, None, 0

    def row(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.string(), pa.int64(), pa.string()))],
            names=["node", "n_ends", "ends_sha256"],
        )

    for batch in batches:
        done = []
        for key, ids, size in zip(*(batch[c].to_pylist() for c in ("node", "ids", "size"))):
            if key != node:
                if node is not None:
                    done.append((node, n, state.hexdigest()))
                node, state, n = key, hashlib.sha256(), 0
            state.update((b"," if n else b"") + ids.encode())
            n += size
        if done:
            yield row(done)
    if node is not None:
        yield row([(node, n, state.hexdigest())])


def _ends(totals: DataFrame) -> DataFrame:
    """``node, n_ends, ends_sha256``: the members whose last turn is the node's.

    Ids are joined in chunks of 2^12 ids first; the chunks of one node pass in order
    through one hash, as SHA-256 asks for.
    """
    chunks = (
        totals.groupBy("node", F.shiftright("conv_id", SPAN_BITS).alias("chunk"))
        .agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
        .select("node", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("bigint").alias("size"))
    )
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(
        _digests, "node string, n_ends long, ends_sha256 string"
    )


def prefix_trie(turns: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``turns`` (``conv_id, pos, digest, chars``) of all ``members``.

    A row per distinct sequence of first turns: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs`` (members), ``n_children``, ``n_leaves`` and
    ``saved_tokens`` of the subtree (characters that sharing saves) and ``ends_sha256`` of
    the members that end there. The root is there if any member is; without members there
    are no rows.

    A first ROLLUP finds each node's smallest member. A member owns the nodes of which it is
    the smallest, a path from some depth to its end, and the sums over subtrees become sums
    over members, which a second ROLLUP adds up: owned characters, own leaf, all characters.
    """
    rows = freeze(_blocks(turns, members, block))
    totals = freeze(
        rows.groupBy("conv_id")
        .agg(*[F.sum(f"s{w}").bitwiseAND(F.lit(MASK)).alias(w) for w in WORDS], F.sum("schars").alias("total"))
        .select("conv_id", _node([F.col(w) for w in WORDS]).alias("node"), "total")
    )
    ends = freeze(_ends(totals))
    first = _rollup(rows, block, "min(conv_id) AS conv_id, count(*) AS n_convs").join(ends.select("node", "n_ends"), "node", "left")
    owners = first.groupBy("conv_id").agg(
        F.min("depth").alias("from_depth"),
        F.min("before").alias("from_chars"),
        (F.max(F.col("before") + F.col("chars")) - F.min("before")).alias("owned"),
        F.max((F.coalesce("n_ends", F.lit(0)) == F.col("n_convs")).cast("bigint")).alias("leaf"),
    )
    info = totals.select("conv_id", "total").join(owners, "conv_id", "left").na.fill(0, ["owned", "leaf"])
    # A long conversation has many rows here.
    known = join_unique(rows, info, "conv_id", ["block"], "inner")
    nodes = freeze(
        _rollup(
            known, block,
            "min(conv_id) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, sum(total) AS total, sum(owned) AS owned, "
            "min_by(from_depth, conv_id) AS from_depth, min_by(from_chars, conv_id) AS from_chars",
        )
    )
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    # Below a member's first own node, the parent is its own as well; many nodes may share the other parents.
    entries = nodes.filter("parent IS NOT NULL AND depth = from_depth").select(F.col("node").alias("child"), F.col("parent").alias("node"))
    parents = join_unique(entries, nodes.select("node", F.col("conv_id").alias("parent_conv_id")), "node", ["child"], "inner").select(
        F.col("child").alias("node"), "parent_conv_id"
    )
    saved = F.col("total") - F.col("n_convs") * F.col("before") - (F.col("owned") + F.col("from_chars") - F.col("before"))
    return (
        nodes.join(children, "node", "left").join(ends, "node", "left").join(parents, "node", "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("parent").isNotNull(), F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            "n_leaves",
            saved.alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
