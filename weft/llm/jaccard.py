"""Jaccard join of word n-grams by signature trees.

A set is a text's distinct n-grams as 64-bit hashes. The steps:

1. ``describe``: size and digest of every set. Equal sets are linked by their digest, and one
   of them goes on.
2. ``candidates``: an exact filter deals sets into lists. Sets of one size class cut the range of
   hashes into the same parts, somewhat more than similar sets can differ in n-grams; of the
   parts in one order, large ones first, similar sets share one of their first few whole
   (``signatures``). A whole part of several n-grams is seldom shared by sets that have only
   a passage in common, however frequent that is. The filter looks at one set at a time.
3. ``_links``: the sets that share a part with the same leader, the smallest set of a list, meet
   in signature trees, whose nodes hold OR-combined bitmaps and size ranges. A dual traversal
   drops pairs of nodes by the maximum possible overlap; pairs of sets that remain are
   counted exactly. Lists are not united before their sets are verified.
4. The links found, a forest for each tree, give the components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import as_bytes, components, map_batches, worker_cache
from weft.operators.skew import join_unique
from weft.session import freeze

WORDS_KEPT = 300_000
# Entries that a map task combines at a time, and that a reduce task holds.
CHUNK = 1_000_000
# Sets with one key among the entries combined at a time from which they pass by the reduce task.
HOT_LIST = 256
# Sets and n-grams that a signature tree holds; n-grams in a task of several trees.
TREE_SETS = 1024
TREE_NGRAMS = 2_000_000
TASK_NGRAMS = 4_000_000
LEAF = 16
FANOUT = 8
LEAST_BITS, MOST_BITS = 256, 1 << 16


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngrams(text: bytes, n: int) -> np.ndarray:
    """The distinct n-grams of a whole text, sorted; a shorter text is one n-gram, none is none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_cache("word hashes", _WordHashes)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = _mixed(total + hashes[k : len(hashes) - size + 1 + k])
    return np.unique(total)


def prefix(size: int, num: int, den: int) -> int:
    """N-grams in the prefix of a set: two similar sets have their first common one there.

    They have at least ``num / den`` of either's n-grams in common, so that many stand from
    the first common one on.
    """
    return size - -(-num * size // den) + 1 if size else 0


def classes(num: int, den: int, limit: int) -> tuple[int, ...]:
    """Bounds of size classes: similar sets are of one class or of two neighbours."""
    bounds = [1]
    while bounds[-1] <= limit:
        bounds.append(bounds[-1] * den // num + 1)
    return tuple(bounds)


def parts(low: int, high: int, num: int, den: int) -> int:
    """Parts for the sets of a size class; 0 if no number serves.

    Sets of the class must fill more parts, but for a chance of about one in a thousand,
    than similar sets differ in n-grams. 1.3 times as many leave small parts to be passed over.
    """

    def filled(size: int, count: int) -> float:
        x = size / count
        spread = max(0.0, count * (math.exp(-x) - (1 + x) * math.exp(-2 * x)))
        return count * (1 - math.exp(-x)) - 3 * math.sqrt(spread)

    most = high * (den - num) // num
    if most == 0:
        return 1
    count = -(-13 * (most + 1) // 10)
    while count <= 4 * high:
        if all(filled(s, count) >= s * (den - num) // num + 1 for s in (low, high)):
            return count
        count += max(1, count // 20)
    return 0


def _plan(size: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """Size classes where a set of ``size`` meets similar ones: the class, its parts, and by how
    many n-grams the set differs from a similar one at most."""

    def make() -> list[tuple[int, int, int]]:
        limit = 1 << max(10, size.bit_length())
        bounds = worker_cache(f"classes {num} {den} {limit}", lambda: classes(num, den, limit))
        own = int(np.searchsorted(bounds, size, side="right"))
        found = []
        for c in (own, own - 1):
            if c < 1:
                continue
            low, high = bounds[c - 1], bounds[c] - 1
            count = worker_cache(f"parts {num} {den} {c}", lambda: parts(low, high, num, den))
            if c == own:
                found.append((c, count, size * (den - num) // num))
            elif high * den >= num * size:
                found.append((c, count, (size + high) * (den - num) // (den + num)))
        return found

    return worker_cache(f"plan {num} {den} {size}", make)


def n_keys(size: int, num: int, den: int) -> int:
    """About how many keys a set has."""
    return sum(min(size, most + 1) for _, _, most in _plan(size, num, den)) if size else 0


def signatures(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set, sorted n-grams: similar sets share one.

    Similar sets differ in ``most`` n-grams at most, and as many whole parts. Of the filled
    parts in one order, the first one in common is therefore among the first ``most + 1`` of
    both, if one of the sets fills more than ``most``. For two that do not, the n-grams of a
    prefix are keys as well: the first one in common is there.
    """
    keys = []
    mixed = _mixed(grams)
    for c, count, most in _plan(len(grams), num, den):
        salt = _mixed(np.array([c], np.uint64))
        filled = 0
        if count:
            part = ((grams >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sizes = np.diff(np.append(starts, len(grams)))
            sums = _mixed(np.add.reduceat(mixed, starts) + salt)
            small = np.uint64(255) - np.minimum(sizes, 255).astype(np.uint64)
            order = (small << np.uint64(56)) | (sums >> np.uint64(8))
            filled = len(order)
            keys.append(_mixed(np.partition(order, most)[: most + 1] if filled > most + 1 else order))
        if filled <= most:
            first = prefix(len(grams), num, den)
            keys.append(_mixed(np.partition(mixed, first - 1)[:first] + ~salt))
    return np.concatenate(keys)


def _describe(n: int, num: int, den: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in as_bytes(batch["text"]):
                grams = ngrams(text or b"", n)
                sizes.append(len(grams))
                digests.append(_digest(grams) if len(grams) else None)
                keys.append(n_keys(len(grams), num, den))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.int64())],
                names=["doc_id", "n", "digest", "keys"],
            )

    return describe


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def describe(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``doc_id, n, digest, keys`` of every row of ``docs(doc_id, text)``, written down."""
    return freeze(map_batches(docs, _describe(n, num, den), "doc_id long, n long, digest binary, keys long"))


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places that hold it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(ordered[a]), order[a:b]


def _distinct(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries in order, and where each key starts."""
    order = np.lexsort((names, keys))
    keys, names = keys[order], names[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])
    keys, names = keys[new], names[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys, names, np.flatnonzero(first)


def _entries(n: int, num: int, den: int, buckets: int):
    """Entries by bucket. Kind 0: keys, 48 bits of each, by set. Where many sets of a chunk have one
    key, only the smallest is an entry; kind 1 marks the key and kind 2 has the sets."""

    def flush(found: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in found])
        names = np.repeat(np.array([i for _, i in found], np.int64), [len(k) for k, _ in found])
        keys, names, starts = _distinct(keys, names)
        counts = np.diff(np.append(starts, len(keys)))
        rows, keep = [], np.ones(len(keys), bool)
        for start, count in zip(starts[counts >= HOT_LIST].tolist(), counts[counts >= HOT_LIST].tolist()):
            key, bucket = keys[start], int(keys[start] % np.uint64(buckets))
            keep[start + 1 : start + count] = False
            name = np.array([key]).tobytes()
            rows.append((bucket, 1, name, b""))
            # Not a group of the reduce task's buckets: it is passed on as it is.
            rows.append((buckets + (int(key) ^ int(names[start])) % (1 << 40), 2, name, names[start : start + count].tobytes()))
        keys, names = keys[keep], names[keep]
        for bucket, at in _groups(keys % np.uint64(buckets)):
            at = at[np.argsort(names[at], kind="stable")]
            whose, sizes = np.unique(names[at], return_counts=True)
            upper, middle = (keys[at] >> np.uint64(32)).astype(np.uint32), (keys[at] >> np.uint64(16)).astype(np.uint16)
            rows.append((bucket, 0, upper.tobytes() + middle.tobytes(), whose.tobytes() + sizes.astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
            names=["bucket", "kind", "a", "b"],
        )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for text in as_bytes(batch["text"]):
                grams = ngrams(text or b"", n)
                if len(grams):
                    found.append((signatures(grams, num, den), int.from_bytes(_digest(grams)[:8], "big", signed=True)))
                    size += len(found[-1][0])
                if size >= CHUNK:
                    yield flush(found)
                    found, size = [], 0
        if found:
            yield flush(found)

    return entries


_LISTS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("lead", pa.int64()), ("names", pa.binary())])


def _reduce(rows: pa.Table) -> pa.Table:
    """Kind 0: a leader with sets that share a key with it; kind 1: the leader of a key that has more sets;
    kind 2: these."""
    keys, names, hot, out = [], [], {}, []
    for kind, left, right in zip(rows["kind"].to_pylist(), rows["a"].to_pylist(), rows["b"].to_pylist()):
        if kind == 0:
            size, owners = len(left) // 6, len(right) // 12
            upper, middle = np.frombuffer(left[: 4 * size], np.uint32), np.frombuffer(left[4 * size :], np.uint16)
            keys.append((upper.astype(np.uint64) << np.uint64(16)) | middle)
            names.append(np.repeat(np.frombuffer(right[: 8 * owners], np.int64), np.frombuffer(right[8 * owners :], np.uint32)))
        elif kind == 1:
            key = int.from_bytes(left, "little", signed=True)
            hot.setdefault((key >> 16) & ((1 << 48) - 1), set()).add(key)
        else:
            out.append((2, int.from_bytes(left, "little", signed=True), None, right))
    if keys:
        key, name, starts = _distinct(np.concatenate(keys), np.concatenate(names))
        leads = name[starts]
        if hot:
            wanted = np.array(sorted(hot), np.uint64)
            for place in np.flatnonzero(np.isin(key[starts], wanted)).tolist():
                out += [(1, whole, int(leads[place]), None) for whole in hot[int(key[starts[place]])]]
        leads = np.repeat(leads, np.diff(np.append(starts, len(key))))
        lead, name, starts = _distinct(leads[leads != name], name[leads != name])
        for a, b in zip(starts, [*starts[1:], len(lead)]):
            out.append((0, None, int(lead[a]), name[a:b].tobytes()))
    return pa.table(
        [pa.array(values, field.type) for values, field in zip(zip(*out) if out else [()] * 4, _LISTS)], schema=_LISTS
    )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each name of a list."""
    for batch in batches:
        names = [np.frombuffer(b, np.int64) for b in batch["names"].to_pylist()]
        leads = np.repeat(batch["lead"].to_numpy(zero_copy_only=False), [len(x) for x in names])
        flat = np.concatenate(names) if names else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(leads, pa.int64()), pa.array(flat, pa.int64())], names=["lead", "name"])


def candidates(docs: DataFrame, entries: int, n: int, num: int, den: int) -> DataFrame:
    """``lead, name``, each once: similar sets of different n-grams share a lead. Leaders lead themselves.

    A name is eight bytes of a set's digest; there are about ``entries`` keys in all. A key of
    very many sets is no task of its own: its sets pass by the task that finds its leader,
    chunk by chunk, and meet the leader in a join.
    """
    buckets = max(1, -(-entries // CHUNK))
    dealt = map_batches(docs, _entries(n, num, den, buckets), "bucket long, kind int, a binary, b binary")
    lists = freeze(dealt.groupBy("bucket").applyInArrow(_reduce, "kind int, key long, lead long, names binary"))
    leaders = lists.filter("kind = 1").select("key", "lead").distinct()
    hot = lists.filter("kind = 2").select("key", "names").join(leaders, "key").select("lead", "names")
    led = map_batches(lists.filter("kind = 0").select("lead", "names").union(hot), _named, "lead long, name long")
    led = freeze(led.filter("lead != name").distinct())
    return led.union(led.select("lead", F.col("lead").alias("name")).distinct())


class SignatureTree:
    """Sets in leaves; above them nodes with OR-combined bitmaps, size ranges and surplus.

    The surplus of a set is its size less the bits it sets: two sets have no more n-grams in
    common than common bits and the smaller surplus.
    """

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        sizes = np.array([len(s) for s in sets], np.int64)
        bitmaps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, grams in zip(bitmaps, sets):
            at = grams & np.uint64(bits - 1)
            np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        surplus = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        # levels[0] are the sets; each level: bitmaps, smallest and largest size, largest surplus.
        self.levels = [(bitmaps, sizes, sizes, surplus)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            below = self.levels[-1]
            cuts = np.arange(0, len(below[0]), width)
            self.levels.append(
                (np.bitwise_or.reduceat(below[0], cuts), np.minimum.reduceat(below[1], cuts),
                 np.maximum.reduceat(below[2], cuts), np.maximum.reduceat(below[3], cuts))
            )
            width = FANOUT

    def children(self, level: int, node: int) -> slice:
        width = LEAF if level == 1 else FANOUT
        return slice(node * width, min((node + 1) * width, len(self.levels[level - 1][0])))


def _possible(one, a: slice, two, b: slice, num: int, den: int) -> np.ndarray:
    """Pairs of nodes that may hold a similar pair, by size range and maximum overlap."""
    common = np.bitwise_count(one[0][a][:, None] & two[0][b][None]).sum(axis=2, dtype=np.int64)
    overlap = common + np.minimum(one[3][a][:, None], two[3][b][None])
    low_a, low_b = one[1][a][:, None], two[1][b][None]
    high_a, high_b = one[2][a][:, None], two[2][b][None]
    overlap = np.minimum(overlap, np.minimum(high_a, high_b))
    # den * overlap >= num * union, where the union is at least both sizes less the overlap.
    return (
        ((num + den) * overlap >= num * (low_a + low_b)) & (den * high_a >= num * low_b) & (den * high_b >= num * low_a)
    )


def forest(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between similar sets that connect all that links connect: at most one a set."""
    if len(sets) < 2:
        return []
    order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
    sets = [sets[i] for i in order]
    longest = max(map(len, sets))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * longest - 1).bit_length()))
    tree = SignatureTree(sets, bits)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    stack = [(len(tree.levels) - 1, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        below = tree.levels[level - 1]
        left, right = tree.children(level, a), tree.children(level, b)
        if level == 1:
            ra = np.array([find(i) for i in range(left.start, left.stop)])
            rb = ra if a == b else np.array([find(i) for i in range(right.start, right.stop)])
            if (ra == rb[0]).all() and (rb == rb[0]).all():
                continue
        possible = _possible(below, left, below, right, num, den)
        if level == 1:
            possible &= ra[:, None] != rb[None]
        for i, j in np.argwhere(possible).tolist():
            i, j = i + left.start, j + right.start
            if a == b and i > j:
                continue
            if level > 1:
                stack.append((level - 1, i, j))
                continue
            x, y = find(i), find(j)
            if x != y:
                common = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
                if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                    root[max(x, y)] = min(x, y)
                    links.append((order[i], order[j]))
    return links


def _link(num: int, den: int):
    def link(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tree", "ascending"), ("doc_id", "ascending")])
        trees = rows["tree"].to_numpy()
        ids = rows["doc_id"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], trees[1:] != trees[:-1])))
        found = []
        for a, b in zip(cuts, [*cuts[1:], len(trees)]):
            sets = [np.frombuffer(blob, np.uint64) for blob in rows["grams"].slice(a, b - a).to_pylist()]
            found += [(ids[a + i], ids[a + j]) for i, j in forest(sets, num, den)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return link


def _grams(n: int):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(t or b"", n).tobytes() for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())], names=["doc_id", "grams"])

    return grams


def link(sets: DataFrame, ngram_total: int, num: int, den: int) -> DataFrame:
    """``a, b``: links inside each tree of ``sets(tree, doc_id, grams)``."""
    tasks = max(1, -(-ngram_total // TASK_NGRAMS))
    return (
        sets.select(F.pmod(F.xxhash64("tree"), F.lit(tasks)).alias("task"), "tree", "doc_id", "grams")
        .groupBy("task")
        .applyInArrow(_link(num, den), "a long, b long")
    )


def _links(docs: DataFrame, members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links inside the clusters of ``members(doc_id, n, cluster)``, written down; a document may be in several.

    A cluster of more sets than a tree holds is cut into blocks by a hash. Blocks are linked
    by themselves; then one set of each part found, of all blocks, and of these the same
    again; at last the sets outside a cluster's largest part meet every block. Two sets of
    different parts cannot both lie in the largest, so no link is left out.
    """
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / TREE_SETS), F.ceil(F.sum("n") / TREE_NGRAMS)).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("sets"),
    )
    chosen = freeze(members.join(sizes.filter("sets > 1").drop("sets"), "cluster"))
    texts = docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    grams = freeze(map_batches(texts, _grams(n), "doc_id long, grams binary"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long"))
    narrow = chosen.withColumn("block", block)
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("blocks") > 1).alias("cut")).first()
    trees = narrow.select(F.xxhash64("cluster", "block").alias("tree"), "doc_id")
    found = freeze(link(trees.join(grams, "doc_id"), total.n, num, den))
    if not total.cut:
        return found

    # From here on only names are moved, and the n-grams of the sets that meet again.
    wide = narrow.filter("blocks > 1")

    def linked(met: DataFrame) -> DataFrame:
        """Links inside the trees of ``met(tree, doc_id, n)``."""
        met = freeze(met.select("tree", "doc_id", "n"))
        weight = met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        return link(met.join(grams, "doc_id"), weight, num, den)

    def parted(links: DataFrame) -> DataFrame:
        roots = components(links)
        return freeze(
            wide.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .withColumn("part", F.coalesce("root", "doc_id"))
            .drop("root")
        )

    # One set of each part: linked again, as long as that leaves fewer.
    count = None
    while True:
        parts_now = parted(found)
        # A part's smallest document may lie outside a cluster, so each cluster has its own.
        heads = parts_now.groupBy("cluster", "part").agg(F.min(F.struct("doc_id", "n")).alias("head")).select(
            "cluster", "head.doc_id", "head.n"
        )
        now = heads.count()
        if count is not None and now >= 0.9 * count:
            break
        count = now
        groups = heads.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / TREE_SETS).alias("heads"))
        again = heads.join(groups, "cluster").withColumn(
            "tree", F.xxhash64("cluster", F.pmod(F.xxhash64("doc_id", F.lit(now)), "heads"))
        )
        found = freeze(found.union(linked(again)))
    counts = parts_now.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("size"))
    largest = counts.groupBy("cluster").agg(F.max_by("part", F.struct("size", "part")).alias("largest"))
    tagged = parts_now.join(largest, "cluster")
    outside = tagged.filter("part != largest")
    beyond = outside.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / TREE_SETS).cast("int").alias("groups"))
    group = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("groups").cast("long"))
    strays = (
        outside.join(beyond, "cluster")
        .withColumn("group", group)
        .withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    )
    hosts = tagged.join(beyond, "cluster").withColumn("group", F.explode(F.expr("sequence(0L, groups - 1L)")))
    names = ["cluster", "block", "group", "doc_id", "n"]
    meeting = strays.select(*names).union(hosts.select(*names)).distinct()
    return freeze(found.union(linked(meeting.withColumn("tree", F.xxhash64("cluster", "block", "group")))))


def similar(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Words are runs of anything but ASCII white space, A to Z in lower case; a document's set
    is its distinct ``n``-word shingles, or its whole sequence if it has fewer words. Two
    documents are linked when the intersection is ``num / den`` of the union or more;
    ``component_id`` is the smallest id that links reach, the document's own included.
    Shingles are compared by 64-bit hashes.

    A text without words, null included, has no shingles and no link. Rows that repeat, and
    rows of one id, are one document of the links; a row without id has its count, no link
    and no component. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sets = describe(rows, n, num, den)
    named = rows.filter("doc_id IS NOT NULL")
    total = sets.agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("keys")).first().keys
    filled = sets.filter("doc_id IS NOT NULL AND n > 0")
    # Equal sets: a star around the smallest id. A digest of many rows is cut into groups.
    smallest = freeze(filled.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("n").alias("n")))
    copies = join_unique(filled.select("doc_id", "digest"), smallest, "digest", ["doc_id"], "inner")
    copies = copies.filter("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    name = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("bigint")
    heads = smallest.select(name.alias("name"), F.col("first").alias("doc_id"), "n")
    members = join_unique(candidates(named, total, n, num, den), heads, "name", ["lead"], "inner")
    members = freeze(members.select("doc_id", "n", F.col("lead").alias("cluster")))
    links = _links(named, members, n, num, den)
    reached = components(links.union(copies))
    return sets.join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id")
    )
