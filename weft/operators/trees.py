"""Bracket trees as node and edge tables.

A tree is one line of text. Lines are spread by line number once; their brackets are linked
where they are, a batch of lines at a time, so they are neither shuffled nor sorted on disk.
A tag with its word is one token.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import SPACE_CLASS, normalise_brackets
from weft.operators.ordering import dense_index
from weft.operators import vocabulary
from weft.operators.vocabulary import UNKNOWN, build_vocab, lookup
from weft.session import freeze

# The wrapper node and the widest node that is expanded.
ROOT = "ROOT"
MAX_CHILDREN = 10
# Levels of a roll-up between two writes to the checkpoint folder.
LEVELS_PER_FREEZE = 8

_WORD = f"[^{SPACE_CLASS}()]+"
_BLANK = f"[{SPACE_CLASS}]"
# A tag with one word, an opening bracket with its label, a closing bracket, a word.
_TOKEN = rf"(?U)\({_BLANK}*{_WORD}{_BLANK}+{_WORD}{_BLANK}*\)|\({_BLANK}*(?:{_WORD})?|\)|{_WORD}"
_LABEL = rf"(?U)^\({_BLANK}*({_WORD})?"
# Kinds of tokens.
CLOSE, WORD, LEAF, OPEN = range(4)
# A node: its token and its parent's in the line, and what ``brackets`` returns.
_NODES = "array<struct<i int, p int, level int, child_no int, node_id int, parent_id int>>"


def _tokens(cfg: Column | str) -> Column:
    return F.regexp_extract_all(normalise_brackets(cfg), F.lit(_TOKEN), F.lit(0))


def is_valid(cfg: Column | str) -> Column:
    """True for one balanced tree with at least one word and nothing outside of it."""
    checked = F.aggregate(
        _tokens(cfg),
        F.expr("named_struct('depth', 0, 'tops', 0, 'words', 0, 'ok', true)"),
        lambda s, t: F.struct(
            (
                s["depth"]
                + F.when(t == ")", -1).when(F.startswith(t, F.lit("(")) & ~F.endswith(t, F.lit(")")), 1).otherwise(0)
            ).alias("depth"),
            (s["tops"] + F.when((s["depth"] == 0) & F.startswith(t, F.lit("(")), 1).otherwise(0)).alias("tops"),
            (
                s["words"]
                + F.when((t != ")") & (F.endswith(t, F.lit(")")) | ~F.startswith(t, F.lit("("))), 1).otherwise(0)
            ).alias("words"),
            (s["ok"] & ((s["depth"] > 0) | (F.startswith(t, F.lit("(")) & (s["tops"] == 0)))).alias("ok"),
        ),
        lambda s: s["ok"] & (s["depth"] == 0) & (s["tops"] == 1) & (s["words"] > 0),
    )
    return F.coalesce(checked, F.lit(False))


def rejects(trees: DataFrame, cfg: str = "cfg") -> DataFrame:
    """The rows whose tree cannot be used."""
    return trees.filter(~is_valid(cfg))


def _linked(
    kinds: np.ndarray,
    ats: np.ndarray,
    starts: np.ndarray,
    rooted: np.ndarray,
    expand: tuple[int, int] | None,
    places: np.ndarray,
) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Number of nodes of each line, and the nodes of all lines as columns with their masks of nulls.

    ``kinds`` and ``ats`` are the tokens of all lines, one line after the other; line ``i``
    begins at ``starts[i]``, and ``places`` says where its tokens come from. Everything is a
    sort or a running sum over the batch.
    """
    line = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    opens, leaves, words = kinds == OPEN, kinds == LEAF, kinds == WORD
    nodes, inside = opens | leaves, kinds != CLOSE
    steps = opens.astype(np.int64) - ~inside
    sums = np.cumsum(steps)
    depth = sums - np.append(0, sums)[starts[:-1]][line]
    level = depth + ~opens

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line[mask], minlength=len(starts) - 1)

    # Balanced, one tree and nothing outside of it, at least one word; all per line.
    valid = (
        (count(depth < 0) == 0)
        & (np.bincount(line, weights=steps, minlength=len(starts) - 1) == 0)
        & (count((level == 1) & inside) == 1)
        & (count((level == 1) & words) == 0)
        & (count(words | leaves) > 0)
    )
    wrapped = rooted & (count((level == 2) & inside) == 1) & (count((level == 2) & nodes) == 1)
    starts_node = opens & np.append(nodes[1:] & (line[1:] == line[:-1]), False)
    place = places - starts[line]

    keep = valid[line]
    line, kinds, ats, level, place = line[keep], kinds[keep], ats[keep], level[keep], place[keep]
    opens, nodes, inside, starts_node = opens[keep], nodes[keep], inside[keep], starts_node[keep]
    n = len(kinds)
    here, wide = np.arange(n), int(max(ats.max(initial=0), level.max(initial=0))) + 3

    # An opening bracket shows up twice: as a node of its level and as the parent of the next.
    above = np.flatnonzero(opens)
    token, lane = np.append(here, above), np.append(level, level[above] + 1)
    in_lane = np.argsort((line[token] * wide + lane) * n + token)
    token, doubled = token[in_lane], in_lane >= n
    last = np.maximum.accumulate(np.where(doubled, np.arange(len(token)), 0))
    parent, until = np.full(n, -1), ats.copy()
    parent[token[~doubled]] = token[last][~doubled]
    parent[level == 1] = -1
    # Nothing stands between a bracket and its closing one in their own lane.
    opening = np.flatnonzero(~doubled & opens[token])
    until[token[opening]] = ats[token[opening + 1]]
    parent_at = np.where(parent >= 0, ats[parent], -1)

    some = np.flatnonzero(inside)
    family = line[some] * wide + parent_at[some] + 1
    order = np.argsort(family * n + some)
    some, family = some[order], family[order]
    first = np.flatnonzero(np.append(True, family[1:] != family[:-1])[: len(some)])
    sizes = np.diff(np.append(first, len(some)))
    child_no, n_children, deeper, node_first = np.zeros((4, n), dtype=np.int64)
    child_no[some] = np.arange(len(some)) - np.repeat(first, sizes) + 1
    n_children[some] = np.repeat(sizes, sizes)
    if len(some):
        deeper[some] = np.repeat(np.maximum.reduceat(starts_node[some].astype(np.int64), first), sizes)
    node_first[some] = np.repeat(kinds[some[first]] != WORD, sizes)

    kept = nodes
    if expand is not None:
        depth_limit, max_children = expand
        level = level - wrapped[line]
        parent_at = np.where(level == 1, -1, parent_at)
        allowed = (n_children <= max_children) & (deeper > 0) & (node_first > 0)
        if depth_limit > 0:
            allowed &= level - 2 < depth_limit
        kept = nodes & (level > 0)
        # A node is gone if a dropped node before it, or itself, reaches as far as here.
        dropped = kept & ~allowed & (level > 1)
        dropped_to = np.maximum.accumulate(np.where(dropped, until, -1) + line * wide) - line * wide
        kept &= dropped_to < ats
    found = np.flatnonzero(kept)
    owner, at, parent, parent_at = line[found], ats[found], parent[found], parent_at[found]
    node_id = np.arange(len(found)) - np.searchsorted(owner, owner)
    ids, wanted = owner * wide + at, owner * wide + parent_at
    by = np.searchsorted(ids, wanted, "right") - 1
    orphan = (parent_at < 0) | (by < 0) | (ids[by] != wanted)
    # Only where two lines share a number can a node stand where its parent stands.
    told = parent_at != at
    columns = {
        "i": (place[found], np.zeros(len(found), dtype=bool)),
        "p": (place[parent], parent < 0),
        "level": (level[found], np.zeros(len(found), dtype=bool)),
        "child_no": (child_no[found], np.zeros(len(found), dtype=bool)),
        "node_id": (node_id, np.zeros(len(found), dtype=bool)),
        "parent_id": (node_id[by], orphan),
    }
    return (
        np.bincount(owner[told], minlength=len(starts) - 1),
        {name: (values[told], nulls[told]) for name, (values, nulls) in columns.items()},
    )


def _linker(expand: tuple[int, int] | None) -> Callable[..., Column]:
    def link(kinds: pa.Array, rooted: pa.Array) -> pa.Array:
        texts = kinds.flatten()
        tokens = np.asarray(texts.offsets).astype(np.int64)
        n_texts = kinds.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(n_texts))
        starts = (tokens - tokens[0])[ends]
        ats = np.arange(starts[-1]) - np.repeat((tokens - tokens[0])[:-1], np.diff(tokens))
        codes, places = texts.flatten().to_numpy(zero_copy_only=False), np.arange(starts[-1])
        if n_texts.max(initial=0) > 1:
            line = np.repeat(np.arange(len(kinds)), np.diff(starts))
            places = np.lexsort((ats, line))
        sizes, columns = _linked(
            codes[places], ats[places], starts, rooted.to_numpy(zero_copy_only=False), expand, places
        )
        structs = pa.StructArray.from_arrays(
            [pa.array(values.astype(np.int32), mask=nulls) for values, nulls in columns.values()], names=list(columns)
        )
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), structs)

    return F.arrow_udf(link, _NODES)


def _bracket_lines(trees: DataFrame, expand: tuple[int, int] | None, line_no: str, cfg: str) -> DataFrame:
    """``line_no, __labels, __nodes``: the labels of the tokens of each line, and its nodes in pre-order."""
    lines = trees.select(line_no, cfg).groupBy(line_no).agg(F.collect_list(cfg).alias("__texts"))
    read = lines.select(line_no, F.transform("__texts", _tokens).alias("__tokens"))
    labelled = read.select(
        line_no,
        F.expr(
            f"transform(__tokens, t -> transform(t, x -> case when x = ')' then {CLOSE}Y when not startswith(x, '(') then {WORD}Y"
            f" when endswith(x, ')') then {LEAF}Y else {OPEN}Y end))"
        ).alias("__kinds"),
        F.transform(
            F.flatten("__tokens"), lambda t: F.when(F.startswith(t, F.lit("(")), F.regexp_extract(t, _LABEL, 1))
        ).alias("__labels"),
    )
    rooted = F.coalesce(F.get("__labels", F.lit(0)) == ROOT, F.lit(False))
    return labelled.select(line_no, "__labels", _linker(expand)("__kinds", rooted).alias("__nodes"))


def brackets(
    trees: DataFrame, expand: tuple[int, int] | None = None, line_no: str = "line_no", cfg: str = "cfg"
) -> DataFrame:
    """``line_no, level, label, parent_label, child_no, node_id, parent_id``: the nodes of all valid trees.

    ``level`` and ``child_no`` count from 1 (words count as children too), ids are pre-order.
    With ``expand`` (depth limit, most children) only the nodes that ``nodes`` keeps, from
    the node inside of a ROOT wrapper on. Lines of one number are read as one, token by token.
    """
    return _bracket_lines(trees, expand, line_no, cfg).select(
        line_no,
        F.inline(
            F.transform(
                "__nodes",
                lambda node: F.struct(
                    node["level"].alias("level"),
                    F.get("__labels", node["i"]).alias("label"),
                    F.get("__labels", node["p"]).alias("parent_label"),
                    node["child_no"].alias("child_no"),
                    node["node_id"].alias("node_id"),
                    node["parent_id"].alias("parent_id"),
                ),
            )
        ),
    )


def bracket_table(trees: DataFrame, line_no: str = "line_no", cfg: str = "cfg") -> DataFrame:
    """``line_no, node_no, level, label, parent_no, child_no``: all nodes in pre-order."""
    return brackets(trees, None, line_no, cfg).select(
        line_no,
        F.col("node_id").alias("node_no"),
        F.col("level").cast("bigint").alias("level"),
        "label",
        F.col("parent_id").alias("parent_no"),
        "child_no",
    )


def nodes(
    trees: DataFrame,
    depth_limit: int = 0,
    max_children: int = MAX_CHILDREN,
    line_no: str = "line_no",
    cfg: str = "cfg",
) -> DataFrame:
    """Node table: ``line_no, node_id, parent_id, depth, pos, mask, enc_label, dec_label, y``.

    A ROOT node with one child node is skipped. The children of a node are dropped, with
    all below them, if there are more than ``max_children``, if the node is at
    ``depth_limit`` (0 for none), or if no child starts with a node. Ids are pre-order.
    """
    kept = brackets(trees, (depth_limit, max_children), line_no, cfg).withColumn("depth", F.col("level") - 1)
    return kept.select(
        line_no,
        "node_id",
        "parent_id",
        "depth",
        F.expr("if(depth = 0, 0, child_no - 1) as pos"),
        F.expr("if(depth = 0, 1, 0) as mask"),
        F.expr("concat(label, '_1') as enc_label"),
        F.expr(f"if(depth = 0, '{ROOT}_1', concat(parent_label, '_', child_no)) as dec_label"),
        F.expr("concat(label, '_1') as y"),
    )


def node_arrays(
    trees: DataFrame,
    depth_limit: int = 0,
    max_children: int = MAX_CHILDREN,
    line_no: str = "line_no",
    cfg: str = "cfg",
) -> DataFrame:
    """``line_no, nodes``: the rows of ``nodes`` as one array a line, in id order; lines without nodes are left out.

    Nodes are built where their line is read, so none is a row that a grouping would hold.
    """
    read = _bracket_lines(trees, (depth_limit, max_children), line_no, cfg).filter(F.size("__nodes") > 0)

    def node(n: Column) -> Column:
        top, label = n["level"] == 1, F.concat(F.get("__labels", n["i"]), F.lit("_1"))
        above = F.concat(F.get("__labels", n["p"]), F.lit("_"), n["child_no"].cast("string"))
        return F.struct(
            n["node_id"].alias("node_id"),
            n["parent_id"].alias("parent_id"),
            (n["level"] - 1).alias("depth"),
            F.when(top, 0).otherwise(n["child_no"] - 1).alias("pos"),
            F.when(top, 1).otherwise(0).alias("mask"),
            label.alias("enc_label"),
            F.when(top, F.lit(f"{ROOT}_1")).otherwise(above).alias("dec_label"),
            label.alias("y"),
        )

    return read.select(line_no, F.transform("__nodes", node).alias("nodes"))


def edges(node_table: DataFrame, line_no: str = "line_no") -> DataFrame:
    """``line_no, graph, src, dst``: child to parent for ``enc``, parent to child for ``dec``."""
    inner = node_table.filter("parent_id is not null")
    return inner.select(
        line_no,
        F.inline(
            F.expr(
                "array(named_struct('graph', 'enc', 'src', node_id, 'dst', parent_id),"
                " named_struct('graph', 'dec', 'src', parent_id, 'dst', node_id))"
            )
        ),
    )


def label_vocab(node_table: DataFrame) -> DataFrame:
    """Vocabulary of the node labels, both kinds."""
    return build_vocab(node_table.select(F.explode(F.array("enc_label", "dec_label")).alias("token")))


def encode_labels(
    node_table: DataFrame, vocab: DataFrame, broadcast_bytes: int | None = None, unknown: str = UNKNOWN
) -> DataFrame:
    """Add ``enc_x, dec_x, y_id``: the ids of the labels."""
    table = lookup(vocab)
    unk = vocab.filter(F.col("token") == unknown).agg(F.max("id")).scalar()
    coded = node_table
    for label, out in (("enc_label", "enc_x"), ("dec_label", "dec_x")):
        named = table.select(F.col("token").alias(label), F.col("id").alias(out))
        coded = vocabulary.dictionary_join(coded, named, label, out, ["line_no", "node_id"], broadcast_bytes).withColumn(
            out, F.coalesce(out, unk)
        )
    return coded.withColumn("y_id", F.col("enc_x"))


def roll_up(
    node_table: DataFrame,
    own: dict[str, Column],
    gather: dict[str, Callable[[str], Column]],
    merge: dict[str, Column],
    max_depth: int | None = None,
    line_no: str = "line_no",
) -> DataFrame:
    """Bottom-up: every node combines the states of its children.

    ``own`` gives a node's state before its children are seen, ``gather`` aggregates a
    state column over the children into ``child_<name>``, ``merge`` makes the state from
    both (``child_<name>`` is NULL for a leaf). One grouping and join per level; the
    number of levels is the depth of the deepest tree.
    """
    base = freeze(node_table)
    if max_depth is None:
        max_depth = base.agg(F.max("depth")).first()[0] or 0
    levels = []
    below = None
    for depth in range(max_depth, -1, -1):
        here = base.filter(F.col("depth") == depth).withColumns(own)
        if below is None:
            here = here.withColumns({f"child_{name}": F.lit(None).cast("bigint") for name in gather})
        else:
            sent = below.groupBy(line_no, F.col("parent_id").alias("node_id")).agg(
                *[agg(name).alias(f"child_{name}") for name, agg in gather.items()]
            )
            here = here.join(sent, [line_no, "node_id"], "left")
        below = here.withColumns(merge).drop(*[f"child_{name}" for name in gather])
        if (max_depth - depth) % LEVELS_PER_FREEZE == LEVELS_PER_FREEZE - 1:
            below = freeze(below)
        levels.append(below)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every


def pass_down(
    node_table: DataFrame,
    root: dict[str, Column],
    step: dict[str, Column],
    max_depth: int | None = None,
    line_no: str = "line_no",
) -> DataFrame:
    """Top-down: every node makes its state from its parent's, seen as ``parent_<name>``."""
    base = freeze(node_table)
    if max_depth is None:
        max_depth = base.agg(F.max("depth")).first()[0] or 0
    above = base.filter("depth = 0").withColumns(root)
    every = above
    for depth in range(1, max_depth + 1):
        states = above.select(
            line_no, F.col("node_id").alias("parent_id"), *[F.col(name).alias(f"parent_{name}") for name in root]
        )
        here = base.filter(F.col("depth") == depth).join(states, [line_no, "parent_id"])
        above = here.withColumns(step).drop(*[f"parent_{name}" for name in root])
        if depth % LEVELS_PER_FREEZE == 0:
            above = freeze(above)
        every = every.unionByName(above)
    return every


def forest(node_table: DataFrame, batch_size: int, line_no: str = "line_no") -> DataFrame:
    """Add ``batch_id, forest_id``: trees in batches, node ids shifted to be unique in a batch."""
    # The trees are read once; the sizes, one row per tree, four times.
    table = freeze(node_table)
    sizes = freeze(table.groupBy(line_no).agg(F.count(F.lit(1)).alias("__n")))
    placed = dense_index(sizes, line_no, "__row").withColumn(
        "batch_id", F.call_function("div", F.col("__row"), F.lit(batch_size))
    )
    before = Window.partitionBy("batch_id").orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.select(
        line_no, "batch_id", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("bigint")).alias("__shift")
    )
    return (
        table.join(shifts, line_no)
        .withColumn("forest_id", F.col("__shift") + F.col("node_id"))
        .drop("__shift")
    )
