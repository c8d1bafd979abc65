"""Groups of spelling variants: k-d trees over letter counts find words one edit apart.

One inserted or deleted letter changes one count by one, a replaced one two counts, up and
down. So for words of length L only the trees of L - 1, L and L + 1 matter, each with a
budget of counts that may go up and down, and a box that asks for more is left out. What
the boxes leave is verified letter by letter.

A tree has two storeys. The upper one, fitted on a bounded sample of the words, cuts the
words of a length into cells and is known everywhere; the lower one is built in a task over
the words of one cell. Every word lives in one cell and visits those its neighbours may live in.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import as_bytes, map_batches
from weft.session import freeze

MIN_LETTERS, MIN_COUNT = 7, 2
SLIP = 31
RATIO = 10
# Lower-cased text of Latin letters; a maximal run of fewer letters is no word.
RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LETTERS},}}")
PIECE = 1 << 20
# Distinct words that a task holds before it hands on their counts.
HELD = 1 << 18

# Words of a cell, the sample that cells are fitted on, and its words for each cell at least.
CELL, SAMPLE, SAMPLE_CELL = 20_000, 1 << 16, 16
LEAF = 12
# Classes of more words with equal counts are verified by look-up and not word by word.
LARGE_CLASS = 64
PAIRS = 1 << 16

# A count for each of a to z, six for the letters from U+00C0 on; unlike letters may share
# one, which only weakens the pruning.
DIMS = 32
_PLACE = np.array([b - 97 if 97 <= b <= 122 else 26 + b % 6 for b in range(256)], np.int64)
_ABOVE_ONE = np.uint64(0xFEFEFEFEFEFEFEFE)


def _runs(text: str) -> Iterator[list[str]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        # A piece ends where no run does go on.
        while end < len(text) and RUN_LETTER.match(text, end - 1) and RUN_LETTER.match(text, end):
            end += 1
        yield RUN.findall(text, at, end)
        at = end


RUN_LETTER = re.compile("[a-zÀ-ÿ]")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def hand_on():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for id, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"])):
            if not text:
                continue
            start = zlib.crc32(b":" if id is None else b"%d:" % id)
            # The lower() of bytes changes A to Z only.
            for words in _runs(text.lower().decode("utf-8", "replace")):
                for word, n in Counter(words).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % SLIP == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < MIN_LETTERS:
                            continue
                    held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield hand_on()
                held.clear()
    yield hand_on()


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the words of whole texts with slips, of 7 letters and 2 occurrences or more.

    A word is a maximal run of Latin letters (to U+00FF), A to Z in lower case. Where the
    CRC-32 of ``<id>:<word>`` is divisible by 31 the letter at its remainder is dropped. A null text has no
    words; a null id counts as an empty one. Tasks add up before the shuffle.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return (
        map_batches(rows, _count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    )


def _letters(words: list[bytes]) -> list[bytes]:
    """UTF-8 words with a byte for each letter."""
    return b"\n".join(words).decode().encode("latin-1").split(b"\n") if words else []


def letter_counts(words: list[bytes]) -> np.ndarray:
    """Counts of the letters of each word, at most 255."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    places = np.repeat(np.arange(len(words)) * DIMS, sizes) + _PLACE[np.frombuffer(b"".join(words), np.uint8)]
    return np.minimum(np.bincount(places, minlength=len(words) * DIMS), 255).astype(np.uint8).reshape(-1, DIMS)


def _within(need: np.ndarray, budget: int) -> np.ndarray:
    """Rows of counts whose sum is ``budget`` (0 or 1) at most.

    Rows are added as four words of eight counts; counts beyond 255 could let a row pass
    that should not, never the other way.
    """
    total = need.view(np.uint64)
    total = total[:, 0] + total[:, 1] + total[:, 2] + total[:, 3]
    if budget == 0:
        return total == 0
    return ((total & (total - np.uint64(1))) == 0) & ((total & _ABOVE_ONE) == 0)


def capacity(length: int) -> int:
    """Words of a cell: fewer when they are long."""
    return max(64, CELL * 16 // max(16, length))


class Cells:
    """The upper storey of one length: splits of letter counts, leaves numbered from 0."""

    def __init__(self, counts: np.ndarray, leaves: int):
        self.dim, self.split, self.left, self.right = [], [], [], []
        self.leaves = 0
        self._cut(counts, leaves)

    def _cut(self, counts: np.ndarray, leaves: int) -> int:
        """Number of the node made; leaves are -1, -2, ..."""
        if leaves > 1 and len(counts) > 1:
            for dim in np.argsort(-counts.var(axis=0), kind="stable")[:DIMS]:
                column = counts[:, dim]
                split = int(np.median(column))
                split -= split == column.max()
                low = column <= split
                if low.any() and not low.all():
                    node, part = len(self.dim), min(leaves - 1, max(1, round(leaves * low.mean())))
                    for values, value in ((self.dim, int(dim)), (self.split, split), (self.left, 0), (self.right, 0)):
                        values.append(value)
                    self.left[node] = self._cut(counts[low], part)
                    self.right[node] = self._cut(counts[~low], leaves - part)
                    return node
        self.leaves += 1
        return -self.leaves

    def reached(self, counts: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf of all leaves that hold anything within ``up`` and ``down`` of a row."""
        rows, leaves = [], []
        at = np.arange(len(counts))
        work = [(0 if self.dim else -1, at, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64))]
        while work:
            node, at, ups, downs = work.pop()
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node - 1))
                continue
            value = counts[at, self.dim[node]].astype(np.int64)
            low = downs + np.maximum(0, value - self.split[node])
            high = ups + np.maximum(0, self.split[node] + 1 - value)
            for child, keep, u, d in ((self.left[node], low <= down, ups, low), (self.right[node], high <= up, high, downs)):
                if keep.any():
                    work.append((child, at[keep], u[keep], d[keep]))
        return np.concatenate(rows), np.concatenate(leaves)


class Tree:
    """The lower storey: a k-d tree with tight boxes over the distinct counts of words of one length."""

    def __init__(self, words: list[bytes], n: list[int]):
        order = sorted(range(len(words)), key=words.__getitem__)
        # Of equal n, the first one is the smallest word.
        self.words = [words[i] for i in order]
        self.n = np.array([n[i] for i in order], np.int64)
        self.length = len(words[0])
        self.codes = np.frombuffer(b"".join(self.words), np.uint8).reshape(len(words), -1)
        counts, inverse = np.unique(letter_counts(self.words), axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        self.members = np.argsort(inverse, kind="stable")
        self.start = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(counts)))))
        self.known: dict[int, dict] = {}
        self._build(counts)

    def _build(self, counts: np.ndarray) -> None:
        place = np.arange(len(counts))
        low, high, child, begin, end = [], [], [], [], []
        work = [(0, len(counts), -1)]
        while work:
            a, b, parent = work.pop()
            node = len(low)
            if parent >= 0:
                child[parent].append(node)
            inside = counts[place[a:b]]
            lo, hi = inside.min(axis=0), inside.max(axis=0)
            low.append(lo)
            high.append(hi)
            child.append([])
            begin.append(a)
            end.append(b)
            if b - a <= LEAF:
                continue
            dim = int(np.argmax(inside.var(axis=0)))
            column = inside[:, dim]
            split = int(np.median(column))
            split -= split == column.max()
            left = column <= split
            place[a:b] = np.concatenate((place[a:b][left], place[a:b][~left]))
            middle = a + int(left.sum())
            work += [(a, middle, node), (middle, b, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.child = np.array([c or [-1, -1] for c in child])
        self.begin, self.end = np.array(begin), np.array(end)
        self.place, self.counts = place, counts

    def _fit(self, counts: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, up: int, down: int) -> np.ndarray:
        mine = counts[at]
        return _within(np.maximum(low, mine) - mine, up) & _within(mine - np.minimum(high, mine), down)

    def classes(self, counts: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``counts`` and the distinct counts within their budgets."""
        at, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        rows, leaves = [], []
        while len(at):
            fit = self._fit(counts, at, self.low[node], self.high[node], up, down)
            at, node = at[fit], node[fit]
            leaf = self.child[node, 0] < 0
            rows.append(at[leaf])
            leaves.append(node[leaf])
            at, node = np.repeat(at[~leaf], 2), self.child[node[~leaf]].ravel()
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        row, at = _ranges(row, self.begin[leaf], self.end[leaf])
        found = self.place[at]
        fit = self._fit(counts, row, self.counts[found], self.counts[found], up, down)
        return row[fit], found[fit]

    def near(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, word of the tree) one edit apart. All ``words`` are of one length."""
        length = len(words[0])
        up, down = (1, 1) if length == self.length else (1, 0) if length < self.length else (0, 1)
        codes = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        row, found = self.classes(letter_counts(words), up, down)
        sizes = self.start[found + 1] - self.start[found]
        pairs = []
        large = sizes > LARGE_CLASS
        for r, c in zip(row[large].tolist(), found[large].tolist()):
            pairs += [(r, h) for h in self._look_up(words[r], c)]
        row, found = row[~large], found[~large]
        mine, its = (np.array(x, np.int64) for x in (list(zip(*pairs)) or ((), ())))
        mine, its = [mine], [its]
        # A class has LARGE_CLASS words at most here, so a slice is bounded.
        step = max(1, PAIRS * 16 // (LARGE_CLASS * max(16, length)))
        for a in range(0, len(row), step):
            part = found[a : a + step]
            r, at = _ranges(row[a : a + step], self.start[part], self.start[part + 1])
            h = self.members[at]
            good = one_edit(codes[r], self.codes[h])
            mine.append(r[good])
            its.append(h[good])
        return np.concatenate(mine), np.concatenate(its)

    def _look_up(self, word: bytes, found: int) -> set[int]:
        """Words of a large class one edit from ``word``, by their forms without one letter."""
        table = self.known.get(found)
        if table is None:
            table = self.known[found] = {}
            for h in self.members[self.start[found] : self.start[found + 1]].tolist():
                w = self.words[h]
                table.setdefault(w, []).append(h)
                for i in range(len(w)):
                    table.setdefault((i, w[:i] + w[i + 1 :]), []).append(h)
        if len(word) > self.length:
            return {h for i in range(len(word)) for h in table.get(word[:i] + word[i + 1 :], ())}
        if len(word) < self.length:
            return {h for i in range(self.length) for h in table.get((i, word), ())}
        return {h for i in range(len(word)) for h in table.get((i, word[:i] + word[i + 1 :]), ()) if self.words[h] != word}


def _ranges(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as often as its range is long, with the places of the range."""
    sizes = end - begin
    if not len(sizes):
        return rows, np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.repeat(rows, sizes), np.arange(int(sizes.sum())) - np.repeat(first - begin, sizes)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced, or by one inserted or deleted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    n = a.shape[1]
    ahead, behind = a != b[:, :n], a != b[:, 1:]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), n)
    last = np.where(behind.any(axis=1), n - 1 - behind[:, ::-1].argmax(axis=1), -1)
    return last < first


class Router:
    """Cells of all lengths; a length without a tree of its own is one cell."""

    def __init__(self, trees: dict[int, Cells]):
        self.trees = trees

    def homes(self, words: list[bytes]) -> np.ndarray:
        return self._cells(words, 0, 0, 0)[1]

    def visits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``words`` and cell of all cells that may hold a near word."""
        found = [self._cells(words, by, *budget) for by, budget in ((-1, (0, 1)), (0, (1, 1)), (1, (1, 0)))]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _cells(self, words: list[bytes], by: int, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + by
        counts = letter_counts(words)
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            tree = self.trees.get(int(size))
            row, leaf = (np.arange(len(at)), 0) if tree is None else tree.reached(counts[at], up, down)
            rows.append(at[row])
            cells.append((int(size) << 20) + leaf + np.zeros(len(row), np.int64))
        row, cell = np.concatenate(rows), np.concatenate(cells)
        if by == up == down == 0:
            order = np.argsort(row)
            row, cell = row[order], cell[order]
        return row, cell


def _house(router):
    def house(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = router.homes(_letters(as_bytes(batch["word"])))
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(cells)], names=["word", "n", "cell"])

    return house


def _send(router, parts: dict[int, int]):
    """Rows of words as inhabitants and visitors of (cell, part)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            utf8 = as_bytes(batch["word"])
            home = batch["cell"].to_numpy()
            row, cell = router.visits(_letters(utf8))
            split = np.array([parts.get(c, 1) for c in cell.tolist()], np.int64)
            row, part = _ranges(row, np.zeros(len(row), np.int64), split)
            cell = np.repeat(cell, split)
            own = np.array([zlib.crc32(w) % parts.get(c, 1) for w, c in zip(utf8, home.tolist())], np.int64)
            for rows, cells, numbers, visits in ((np.arange(len(utf8)), home, own, False), (row, cell, part, True)):
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), pa.array(numbers), pa.array(np.full(len(rows), visits)), batch["word"].take(taken), batch["n"].take(taken)],
                    names=["cell", "part", "visits", "word", "n"],
                )

    return send


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the visitors of every cell; its inhabitants come first and are held, visitors pass."""
    key, words, counts, tree = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, part, visits = (batch[c].to_numpy(zero_copy_only=False) for c in ("cell", "part", "visits"))
        utf8, n = as_bytes(batch["word"]), batch["n"].to_numpy()
        edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(visits) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cell)]):
            if key != (cell[a], part[a]):
                key, words, counts, tree = (cell[a], part[a]), [], [], None
            letters = _letters(utf8[a:b])
            if not visits[a]:
                words += letters
                counts += n[a:b].tolist()
                continue
            if not words:
                continue
            if tree is None:
                tree = Tree(words, counts)
            sizes = np.fromiter(map(len, letters), np.int64, len(letters))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                mine, its = tree.near([letters[i] for i in at])
                if not len(mine):
                    continue
                # The first of each row is its form: the largest n, of equal ones the smallest word.
                order = np.lexsort((its, -tree.n[its], mine))
                row, first, number = np.unique(mine[order], return_index=True, return_counts=True)
                best = its[order][first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([utf8[a + at[r]].decode() for r in row], pa.string()), pa.array(number.astype(np.int64)),
                        pa.array([tree.words[h].decode("latin-1") for h in best], pa.string()), pa.array(tree.n[best]),
                    ],
                    names=["word", "n_near", "form", "form_n"],
                )


def near_words(counts: DataFrame) -> DataFrame:
    """``word, n_near, form, form_n`` of every word of ``counts`` (``word, n``) with a near word.

    ``form`` is the near word of the largest ``n``, of equal ones the smallest. ``word`` is
    unique and of letters up to U+00FF.

    Cells are fitted on SAMPLE words at most, which reach the driver. A cell that is larger
    than meant, as its words have equal counts or the sample missed them, is cut into parts
    by a hash, and its visitors go to all of them.
    """
    counts = freeze(counts)
    sizes = counts.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    full = {r["length"]: r["n"] for r in sizes.filter(F.col("n") > CELL).collect()}
    full |= {r["length"]: r["n"] for r in sizes.filter((F.col("length") > 16) & (F.col("n") * F.col("length") > CELL * 16)).collect()}
    trees = {}
    if full:
        # A hash draws an even share; a little below the bound, which is then all but sure.
        share = min(1.0, 0.9 * SAMPLE / sum(full.values()))
        drawn = counts.filter(F.length("word").isin(list(full)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))))
        sample: dict[int, list[bytes]] = {}
        for row in drawn.select("word").orderBy(F.xxhash64("word")).limit(SAMPLE).collect():
            sample.setdefault(len(row["word"]), []).append(row["word"].encode("latin-1"))
        for length, words in sample.items():
            leaves = min(-(-full[length] // capacity(length)), max(1, len(words) // SAMPLE_CELL))
            trees[length] = Cells(letter_counts(words), leaves)
    router = Router(trees)
    housed = freeze(counts.mapInArrow(_house(router), "word string, n long, cell long"))
    filled = freeze(housed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    limit = F.greatest(F.lit(64), F.lit(2 * CELL * 16) / F.greatest(F.lit(16), F.shiftright("cell", 20)))
    # Only cells of trees can be: there are SAMPLE / SAMPLE_CELL of them at most.
    parts = {r["cell"]: -(-r["n"] // capacity(r["cell"] >> 20)) for r in filled.filter(F.col("n") > limit).collect()}
    blocks = filled.count() + sum(parts.values())
    sent = housed.mapInArrow(_send(router, parts), "cell long, part long, visits boolean, word string, n long")
    # The work of a cell is far larger than its bytes: cells are kept apart, not merged by size.
    found = sent.repartition(max(1, 3 * blocks), "cell", "part").sortWithinPartitions("cell", "part", "visits").mapInArrow(
        _search, "word string, n_near long, form string, form_n long"
    )
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best")["form"].alias("form"), (-F.col("best")["m"]).alias("form_n")
    )


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``counts``.

    ``form``: the near word of the largest ``n``, if that is ``ratio`` times the word's own
    or more. ``root``: the end of the chain of forms, found by doubling; as ``n`` grows by
    ``ratio`` at every step there are few. Empty counts give no rows.
    """
    counts = freeze(counts)
    near = near_words(counts)
    known = counts.join(near, "word", "left")
    good = F.col("form_n") >= F.col("n") * ratio
    known = freeze(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"),
        )
    )
    steps = freeze(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = freeze(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return known.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
