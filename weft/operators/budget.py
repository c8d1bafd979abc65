"""Token-budget batches of a whole corpus, exactly as one scan in line order makes them.

A batch ends where one more row would lift (longest row) x (rows) above the budget, so a
scan carries a state from row to row. The only thing that a slice of the corpus needs to
know from those before is where the first batch begins in it, and a batch has no more rows
than the budget has tokens. So each slice, which sees ``budget`` rows beyond its end, gives for
every possible entry the exit into the next slice and the number of batches between; these
maps are composed over a tree, and the entries come down the same tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import freeze

SLICE_ROWS = 30_000
# Maps that one task composes: about 64 MB of them.
FAN_BYTES = 64 << 20
_MAP = "node long, rows long, exits binary, counts binary"


def reaches(lengths: np.ndarray, budget: int) -> np.ndarray:
    """For a batch that begins at each row, the row where the next one begins.

    Spans of powers of two are tried from the longest, each with its longest row known. A
    row above the budget is a batch alone.
    """
    n = len(lengths)
    tables = [lengths.astype(np.int64)]
    while (1 << len(tables)) <= min(n, budget):
        half = 1 << (len(tables) - 1)
        tables.append(np.maximum(tables[-1][:-half], tables[-1][half:]))
    begin = np.arange(n)
    reach, longest = begin.copy(), np.zeros(n, np.int64)
    for power in range(len(tables) - 1, -1, -1):
        span = 1 << power
        fits = np.flatnonzero(reach + span <= n)
        wider = np.maximum(longest[fits], tables[power][reach[fits]])
        good = wider * (reach[fits] + span - begin[fits]) <= budget
        longest[fits[good]] = wider[good]
        reach[fits[good]] += span
    return np.maximum(reach, begin + 1)


def entry_map(lengths: np.ndarray, rows: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Exit and number of batches for every entry of a slice of ``rows`` rows.

    ``lengths`` goes on for ``budget`` rows beyond the slice, or to the end of the corpus.
    Entries and exits count from the beginning of the slice and of the next one.
    """
    after = np.arange(len(lengths) + 1)
    after[:rows] = reaches(lengths, budget)[:rows]
    count = (after != np.arange(len(after))).astype(np.int64)
    # Jumps double until all have left the slice.
    while (after[:rows] < rows).any():
        count += count[after]
        after = after[after]
    entries = np.arange(budget)
    inside = entries < rows
    exits, counts = entries - rows, np.zeros(budget, np.int64)
    exits[inside], counts[inside] = after[: inside.sum()] - rows, count[: inside.sum()]
    return exits, counts


def batch_starts(lengths: np.ndarray, entry: int, budget: int) -> np.ndarray:
    """Rows of a slice at which batches begin, from the first one on."""
    after = reaches(lengths, budget) if len(lengths) else lengths
    starts, at = [], entry
    while at < len(lengths):
        starts.append(at)
        at = int(after[at])
    return np.array(starts, np.int64)


def _maps(table: pa.Table, node: int, rows: int, exits: np.ndarray, counts: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "node": pa.array([node], pa.int64()), "rows": pa.array([rows], pa.int64()),
            "exits": pa.array([exits.astype(np.int64).tobytes()], pa.binary()),
            "counts": pa.array([counts.astype(np.int64).tobytes()], pa.binary()),
        }
    )


def _slice_map(budget: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["row"].to_numpy(), kind="stable")
        row, length = table["row"].to_numpy()[order], table["len"].to_numpy()[order]
        node = int(table["node"][0].as_py())
        rows = int((row < (node + 1) * size).sum())
        if (row != node * size + np.arange(len(row))).any():
            raise ValueError("line numbers must be consecutive from 0")
        return _maps(table, node, rows, *entry_map(length, rows, budget))

    return run


def _read_maps(table: pa.Table):
    for i in np.argsort(table["node"].to_numpy()):
        yield (
            int(table["node"][int(i)].as_py()), int(table["rows"][int(i)].as_py()),
            np.frombuffer(table["exits"][int(i)].as_py(), np.int64), np.frombuffer(table["counts"][int(i)].as_py(), np.int64),
        )


def _compose(table: pa.Table) -> pa.Table:
    exits = counts = None
    rows = 0
    for _, n, leave, number in _read_maps(table):
        rows += n
        # An exit beyond the corpus stays beyond it; there is no slice left that could ask.
        if exits is None:
            exits, counts = leave, number
        else:
            counts = counts + number[exits]
            exits = leave[exits]
    return _maps(table, int(table["parent"][0].as_py()), rows, exits, counts)


def _descend(maps: pa.Table, entries: pa.Table) -> pa.Table:
    """Entry and first batch number of every child of a node."""
    entry, number = int(entries["entry"][0].as_py()), int(entries["number"][0].as_py())
    out = []
    for node, _, leave, count in _read_maps(maps):
        out.append((node, entry, number))
        entry, number = int(leave[entry]), number + int(count[entry])
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("node", "entry", "number"), zip(*out))})


def _number(budget: int, line_no: str):
    def run(rows: pa.Table, entries: pa.Table) -> pa.Table:
        order = np.argsort(rows["row"].to_numpy(), kind="stable")
        lengths = rows["len"].to_numpy()[order]
        entry, number = int(entries["entry"][0].as_py()), int(entries["number"][0].as_py())
        step = np.zeros(len(lengths), np.int64)
        step[batch_starts(lengths, entry, budget)] = 1
        # Rows before the first start still belong to the batch of the slice before.
        return pa.table({line_no: rows["row"].take(pa.array(order)), "batch_no": np.cumsum(step) + number - 1})

    return run


def token_batches(
    df: DataFrame,
    budget: int,
    n_src: str = "n_src",
    n_tgt: str = "n_tgt",
    line_no: str = "line_no",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``line_no, batch_no``: batches whose padded size stays within ``budget`` tokens.

    Equal to one scan over all lines, whatever ``slice_rows`` is (raised to the budget if
    it is below). The length of a row is that of its longer side, 1 at least; line numbers
    are 0, 1, 2, ... without gaps; both are checked. A row above the budget is a batch alone; as
    the first row it leaves batch 0 empty. An empty corpus gives no rows.

    Two shuffles of (number, length) by slice; a task holds one slice and ``budget`` rows
    more. Maps take 16 bytes for each token of the budget and slice.
    """
    size = max(slice_rows, budget)
    length = F.greatest(n_src, n_tgt).cast("bigint")
    rows = freeze(
        df.select(
            F.col(line_no).cast("bigint").alias("row"),
            F.when(length >= 1, length).otherwise(F.raise_error(F.lit("a row has no tokens"))).alias("len"),
        ).withColumn("node", F.call_function("div", "row", F.lit(size)))
    )
    before = F.when((F.col("node") > 0) & (F.col("row") < F.col("node") * size + budget), F.array(F.col("node") - 1, F.col("node")))
    seen = rows.withColumn("node", F.explode(F.coalesce(before, F.array("node"))))
    levels = [freeze(seen.groupBy("node").applyInArrow(_slice_map(budget, size), _MAP))]
    n = levels[0].count()
    if n == 0:
        return rows.select(F.col("row").alias(line_no), F.lit(0).cast("bigint").alias("batch_no"))
    fan = max(2, FAN_BYTES // (16 * budget))
    while n > 1:
        parents = levels[-1].withColumn("parent", F.call_function("div", "node", F.lit(fan)))
        levels.append(freeze(parents.groupBy("parent").applyInArrow(_compose, _MAP)))
        n = -(-n // fan)
    first = rows.filter("row = 0").select(F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("entry"), (F.col("len") > budget).cast("bigint").alias("number"))
    entries = first
    for maps in reversed(levels[:-1]):
        children = maps.withColumn("parent", F.call_function("div", "node", F.lit(fan)))
        entries = freeze(
            children.groupBy("parent").cogroup(entries.withColumnRenamed("node", "parent").groupBy("parent")).applyInArrow(
                _descend, "node long, entry long, number long"
            )
        )
    return rows.groupBy("node").cogroup(entries.groupBy("node")).applyInArrow(_number(budget, line_no), f"{line_no} long, batch_no long")
