"""Byte-pair encoding: learning merges over word types, applying them to a corpus.

The corpus is counted once into word types. Learning works on that table in rounds, and a
round learns many merges. Its pairs are counted over all types; the K most frequent are let in, and no
other is more frequent than some count T. Each type is cut where a pair is not let in, and
equal cuts are added up: a table of bounded size. As long as the best pair counts more than T, all its
occurrences lie in the cuts, and so do all that its merging makes. So the driver plays
the merges through on the cuts, one by one, until T is reached, and the types take over the round's merges.
A round also ends when a merge makes a symbol that was there before in another way: its
neighbours may then be known in part only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.text import split_chars
from weft.operators.vocabulary import broadcastable, frequent, token_counts, translate
from weft.session import freeze, spread

# End of word inside a merge, and the mark of a piece that is not the last.
WORD_END = "</w>"
CONTINUED = "@@"
# Pairs let in by a round at most, and distinct cuts that reach the driver at most.
ROUND_PAIRS = 20_000
ROUND_CUTS = 200_000
# Distinct cuts that a task holds before it hands on their counts.
HELD = 100_000

Pair = tuple[str, str]


def _falling(text: str) -> tuple[int, ...]:
    """A key under which the larger string comes first; 1 ends it, so the longer one does too."""
    return (*(-ord(c) for c in text), 1)


class _Cuts:
    """Weighted sequences of symbols under merges, with the pairs counted as they change."""

    def __init__(self, cuts: list[tuple[list[str], int]]):
        self.symbols = [symbols for symbols, _ in cuts]
        self.weight = [weight for _, weight in cuts]
        self.count: dict[Pair, int] = {}
        self.where: dict[Pair, set[int]] = {}
        for i, symbols in enumerate(self.symbols):
            for pair in zip(symbols, symbols[1:]):
                self.count[pair] = self.count.get(pair, 0) + self.weight[i]
                self.where.setdefault(pair, set()).add(i)
        self.heap = [self._entry(pair) for pair in self.count]
        heapq.heapify(self.heap)

    def _entry(self, pair: Pair):
        return (-self.count[pair], _falling(pair[0]), _falling(pair[1]), pair)

    def best(self) -> tuple[Pair, int] | None:
        """The pair that ranks first by (count, left, right), all downward."""
        while self.heap:
            count, _, _, pair = self.heap[0]
            if self.count.get(pair) == -count:
                return pair, -count
            heapq.heappop(self.heap)
        return None

    def merge(self, pair: Pair) -> None:
        changed: set[Pair] = set()
        for i in self.where.pop(pair):
            old, weight = self.symbols[i], self.weight[i]
            new = merged(old, pair)
            if len(new) == len(old):
                continue
            for p in zip(old, old[1:]):
                self.count[p] -= weight
                changed.add(p)
            for p in zip(new, new[1:]):
                self.count[p] = self.count.get(p, 0) + weight
                self.where.setdefault(p, set()).add(i)
                changed.add(p)
            self.symbols[i] = new
        for p in changed:
            if self.count[p]:
                heapq.heappush(self.heap, self._entry(p))
            else:
                del self.count[p]
                self.where.pop(p, None)


def merged(symbols: list[str], pair: Pair) -> list[str]:
    """``pair`` merged wherever it occurs, from the left."""
    out: list[str] = []
    i = 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == pair[0] and symbols[i + 1] == pair[1]:
            out.append(pair[0] + pair[1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def _merge_all(symbols: list[str], ranks: dict[Pair, int]) -> list[str]:
    """All merges of ``ranks`` that apply, the earliest one first."""
    while len(symbols) > 1:
        known = [rank for pair in zip(symbols, symbols[1:]) if (rank := ranks.get(pair)) is not None]
        if not known:
            break
        target = min(known)
        symbols = merged(symbols, next(p for p in zip(symbols, symbols[1:]) if ranks.get(p) == target))
    return symbols


def _pair_counts(table: DataFrame) -> DataFrame:
    pairs = F.expr("transform(sequence(0, size(s) - 2), i -> named_struct('l', s[i], 'r', s[i + 1]))")
    return (
        table.select("cnt", F.split("symbols", " ", -1).alias("s"))
        .filter(F.size("s") > 1)
        .select("cnt", F.explode(pairs).alias("p"))
        .groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r"))
        .agg(F.sum("cnt").alias("n"))
    )


def _cut(allowed: set[Pair]):
    """The stretches of each type within which every pair is allowed, added up over a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        for batch in batches:
            for text, cnt in zip(batch["symbols"], batch["cnt"]):
                symbols = text.split(" ")
                begin = 0
                for i in range(1, len(symbols) + 1):
                    if i == len(symbols) or (symbols[i - 1], symbols[i]) not in allowed:
                        if i - begin > 1:
                            cut = " ".join(symbols[begin:i])
                            held[cut] = held.get(cut, 0) + cnt
                        begin = i
            if len(held) > HELD:
                yield pd.DataFrame({"cut": list(held), "cnt": list(held.values())})
                held.clear()
        yield pd.DataFrame({"cut": list(held), "cnt": list(held.values())}).astype({"cut": str, "cnt": "int64"})

    return run


def _take_over(ranks: dict[Pair, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(symbols=[" ".join(_merge_all(text.split(" "), ranks)) for text in batch["symbols"]])

    return run


def learn_bpe(
    types: DataFrame, merges: int = 16_000, min_count: int = 2, pairs: int = ROUND_PAIRS, cuts: int = ROUND_CUTS
) -> DataFrame:
    """``rank, left, right, cnt``: the first ``merges`` merges of a table ``token, cnt``.

    Pairs rank by (count, left, right), all downward. The list is the one that merging a
    single pair at a time gives, whatever ``pairs`` and ``cuts``, which bound what a round
    sends to the driver; a round that would send more cuts lets fewer pairs in. Where more than
    ``pairs`` pairs share the highest count, or one pair alone gives too many cuts, a round learns one merge. Tokens hold no blank.
    """
    chars = split_chars("token")
    table = freeze(
        types.filter(F.size(chars) > 1).select(
            F.col("cnt").cast("bigint").alias("cnt"), F.concat(F.array_join(chars, " "), F.lit(WORD_END)).alias("symbols")
        )
    )
    learnt: list[tuple[str, str, int]] = []
    made: set[str] = set()
    room = pairs
    while len(learnt) < merges:
        counted = freeze(_pair_counts(table).filter(F.col("n") >= min_count))
        ranking = counted.orderBy(F.col("n").desc(), F.col("l").desc(), F.col("r").desc()).limit(room + 1).collect()
        if not ranking:
            break
        found: list[dict] | None = None
        while found is None:
            # No pair outside is more frequent than the first one left out.
            bound = ranking[room]["n"] if len(ranking) > room else min_count - 1
            allowed = {(r["l"], r["r"]) for r in ranking[:room] if r["n"] > bound}
            if not allowed:
                break
            every = table.mapInPandas(_cut(allowed), "cut string, cnt bigint").groupBy("cut").agg(F.sum("cnt").alias("cnt"))
            found = every.limit(cuts + 1).collect()
            if len(found) > cuts:
                found = None
                if room == 1:
                    break
                room = max(1, room // 4)
        run: list[tuple[str, str, int]] = []
        if found is None:
            first = ranking[0]
            run.append((first["l"], first["r"], first["n"]))
            made.add(first["l"] + first["r"])
        else:
            played = _Cuts([(r["cut"].split(" "), r["cnt"]) for r in found])
            while len(learnt) + len(run) < merges and (best := played.best()) is not None and best[1] > bound:
                played.merge(best[0])
                run.append((*best[0], best[1]))
                product = best[0][0] + best[0][1]
                again = product in made or len(product.removesuffix(WORD_END)) == 1
                made.add(product)
                if again:
                    break
        learnt += run
        if len(learnt) < merges:
            ranks = {(left, right): rank for rank, (left, right, _) in enumerate(run)}
            table = freeze(table.mapInPandas(_take_over(ranks), "cnt bigint, symbols string"))
        room = min(pairs, 2 * room)
    rows = [(rank, left, right, count) for rank, (left, right, count) in enumerate(learnt)]
    return types.sparkSession.createDataFrame(rows, "rank bigint, left string, right string, cnt bigint")


def _segment(word: str, ranks: dict[Pair, int]) -> list[str]:
    return _merge_all([*word[:-1], word[-1] + WORD_END], ranks)


def _printed(symbol: str) -> str:
    return symbol[: -len(WORD_END)] if symbol.endswith(WORD_END) else symbol + CONTINUED


def _split_rare(symbol: str, parts: dict[str, tuple[str, str]], allowed: set[str]) -> list[str]:
    """Undo merges until every piece is allowed or a single character."""
    if symbol not in parts or _printed(symbol) in allowed:
        return [symbol]
    left, right = parts[symbol]
    return _split_rare(left, parts, allowed) + _split_rare(right, parts, allowed)


def segment_types(types: DataFrame, merges: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``token, pieces`` (and further columns of ``types``): each word type once.

    ``allowed`` lists the pieces (column ``piece``) that may stay merged. Both it and the
    merges are bounded by the number of merges, so they travel with the function.
    """
    found = [(row["left"], row["right"]) for row in merges.orderBy("rank").collect()]
    ranks = {pair: rank for rank, pair in enumerate(found)}
    parts = {left + right: (left, right) for left, right in reversed(found)}
    keep = None
    if allowed is not None:
        products = types.sparkSession.createDataFrame([(_printed(p),) for p in parts] or [("",)], "piece string")
        kept = allowed.join(F.broadcast(products), "piece", "left_semi")
        keep = {row["piece"] for row in kept.collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = []
            for word in batch["token"]:
                symbols = _segment(word, ranks) if word else []
                if keep is not None:
                    symbols = [piece for s in symbols for piece in _split_rare(s, parts, keep)]
                pieces.append([_printed(s) for s in symbols])
            yield batch.assign(pieces=pieces)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types.schema.fields)
    return types.mapInPandas(run, f"{fields}, pieces array<string>")


def piece_counts(types: DataFrame, merges: DataFrame) -> DataFrame:
    """``piece, cnt`` of the segmented corpus, from its types ``token, cnt``."""
    pieces = segment_types(types, merges).select("cnt", F.explode("pieces").alias("piece"))
    return pieces.groupBy("piece").agg(F.sum("cnt").alias("cnt"))


def apply_bpe(
    df: DataFrame,
    merges: DataFrame,
    keys: Sequence[str],
    tokens: str = "tokens",
    pieces: DataFrame | None = None,
    threshold: int = 10,
) -> DataFrame:
    """``keys, tokens``: token arrays as arrays of pieces; each word type is segmented once.

    With ``pieces`` (``piece, cnt``), merged pieces seen fewer than ``threshold`` times are
    split again.
    """
    keys = list(keys)
    types = token_counts(df.select(F.explode(tokens).alias("token")))
    allowed = None if pieces is None else frequent(pieces, threshold).select("piece")
    dictionary = freeze(segment_types(types, merges, allowed))
    if not broadcastable(dictionary, "token", "pieces"):
        found = translate(df, dictionary, keys, tokens, "token", "pieces", "__pieces")
        return found.select(*keys, F.flatten(F.filter("__pieces", lambda x: x.isNotNull())).alias(tokens))
    unnested = spread(df.select(*keys, tokens), *keys).select(
        *keys, F.posexplode_outer(tokens).alias("__pos", "token")
    )
    joined = unnested.join(F.broadcast(dictionary), "token", "left")
    ordered = F.array_sort(
        F.collect_list(F.when(F.col("pieces").isNotNull(), F.struct("__pos", "pieces")))
    )
    return joined.groupBy(*keys).agg(
        F.flatten(F.transform(ordered, lambda x: x["pieces"])).alias(tokens)
    )
