"""Best-fit packing by linear grouping: tokens, pieces, sequences."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import as_bytes, map_batches, worker_cache
from weft.session import freeze

CAPACITY = 4096
END_ID = 1
# Pieces packed together: about two thousand sequences, of which the last ones may be open.
SHARD_PIECES = 8192
# Groups, and the part of the capacity above which lengths are grouped, for a coarse and a fine
# grouping: many parts to a sequence with few sizes, or few parts with many sizes.
GROUPINGS = ((12, 5), (100, 3))
CACHE_WORDS = 1_000_000

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
# Marks that are cut off. Not ">", which ends the special tokens, and not the apostrophe, which begins some tokens.
_TAIL = b".,!?;:#$%&*|<"
# Lower-case letters of one code point that the normalizer keeps.
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


class WordEncoder:
    """Token ids of texts, as little-endian bytes, word by word with a memory of words.

    The tokenizer never joins characters across white space, so a text's ids are those of
    its words in a row. It lowers case, so words are kept in lower case. Marks at the end of a word
    that ends in a letter are a token run of their own. Words of letters alone are encoded
    many at a time: each of them ends in its only end-of-word token. Those of letters that
    the normalizer leaves as they are pass it by.
    """

    def __init__(self, path: str):
        # One thread a task; the tokenizer must not start a pool of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        vocabulary = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.ends = ends
        self.words: dict[bytes, bytes] = {}
        # The words known before the memory was last full: those that come again go over.
        self.older: dict[bytes, bytes] = {}

    def _each(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, tokenizer, words: list[bytes]) -> list[bytes]:
        """Words of letters alone, as one text."""
        if not words:
            return []
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._each(words)
        packed, cuts = ids.tobytes(), (4 * ends).tolist()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts)]

    def learn(self, words: set[bytes]) -> None:
        heads, forms = set(), []
        for word in words:
            if word[-1] in _TAIL:
                head = word.rstrip(_TAIL)
                # In lower case, the last of its characters may be a mark on a letter.
                if head.decode()[-1:].lower()[-1:].isalpha():
                    forms.append((word, head))
                    word = head
            heads.add(word)
        # A head is kept as well: it may come with other marks.
        latin, letters, odd = [], [], []
        for head in heads.difference(self.words):
            text = head.decode()
            (latin if _LATIN(text) else letters if text.isalpha() else odd).append(head)
        self.words.update(zip(latin, self._letters(self.bare, latin)))
        self.words.update(zip(letters, self._letters(self.tokenizer, letters)))
        self.words.update(zip(odd, self._each(odd)))
        tails = list({word[len(head) :] for word, head in forms})
        marks = dict(zip(tails, self._each(tails)))
        self.words.update([(word, self.words[head] + marks[word[len(head) :]]) for word, head in forms])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # Special tokens are told by their case.
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        here = set().union(*split)
        if len(self.words) > CACHE_WORDS // 2:
            self.words, self.older = {}, self.words
        missing = here.difference(self.words)
        if self.older:
            again = missing.intersection(self.older)
            self.words.update([(word, self.older[word]) for word in again])
            missing -= again
        if missing:
            self.learn(missing)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _tokenize(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"words:{path}", lambda: WordEncoder(path))
        for batch in batches:
            rows = []
            texts = as_bytes(batch["text"])
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode([t or b"" for t in texts])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

    return tokenize


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents as token ids, cut if too long.

    A document is its tokenizer ids and ``end_id``; a null or empty text is ``end_id``
    alone. Only documents of more than ``capacity`` ids are cut.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(
        rows, _tokenize(tokenizer, capacity, end_id),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def configurations(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Every multiset of sizes that fits, as counts; the empty one left out."""
    most = int(capacity // sizes.min())
    found = []
    for k in range(1, most + 1):
        some = np.array(list(combinations_with_replacement(range(len(sizes)), k)), np.int64)
        some = some[sizes[some].sum(axis=1) <= capacity]
        counts = np.zeros((len(some), len(sizes)), np.int64)
        for column in some.T:
            np.add.at(counts, (np.arange(len(some)), column), 1)
        found.append(counts)
    return np.concatenate(found)


def fewest(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used: the linear programme, rounded down.

    Minimises the number of sequences that cover the demand with configurations of the few
    sizes, by the simplex method over the listed configurations. What rounding leaves is
    packed with the small lengths.
    """
    columns = configurations(sizes, capacity)
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(50 * m):
        prices = np.linalg.solve(basis.T, np.ones(m))
        gains = columns @ prices
        enter = int(np.argmax(gains))
        if gains[enter] <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, columns[enter].astype(float))
        level = np.linalg.solve(basis, demand.astype(float))
        ratios = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(np.argmin(ratios))] = columns[enter]
    level = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, i].astype(np.int64), int(np.floor(x + 1e-9))) for i, x in enumerate(level) if x >= 1 - 1e-9]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the place in it of every length, by the better of two groupings."""
    tried = [pack_by(lengths, capacity, groups, part) for groups, part in GROUPINGS]
    return min(tried, key=lambda t: t[0].max(initial=-1))


def pack_by(lengths: np.ndarray, capacity: int, groups: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the place in it of every length, by linear grouping and best fit.

    Lengths above ``capacity / part`` are sorted and cut into ``groups`` of equal
    cardinality; a group counts as its longest length. The configurations of these few
    sizes that need the fewest sequences are filled with the groups' real documents. All
    that is left, the small lengths included, goes by falling length to the sequence with
    the least room that is enough, or to a new one.
    """
    n = len(lengths)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((np.arange(n), -lengths))
    room: list[int] = []
    large = order[lengths[order] * part > capacity]
    if len(large) >= groups:
        parts = np.array_split(large, groups)
        sizes = np.array([lengths[p[0]] for p in parts])
        # Groups of one rounded size are one group.
        same = {int(s): [int(i) for j, p in enumerate(parts) if sizes[j] == s for i in p] for s in sizes}
        sizes = np.array(sorted(same, reverse=True))
        waiting = [same[int(s)][::-1] for s in sizes]
        for config, times in fewest(sizes, np.array([len(w) for w in waiting]), capacity):
            for _ in range(times):
                used = 0
                for g, count in enumerate(config):
                    for _ in range(int(count)):
                        if waiting[g]:
                            i = waiting[g].pop()
                            sequence[i], offset[i] = len(room), used
                            used += int(lengths[i])
                if used:
                    room.append(capacity - used)
    # Sequences by the room they have left; the rooms that occur, in order.
    by_room: dict[int, list[int]] = {}
    for s, r in enumerate(room):
        by_room.setdefault(r, []).append(s)
    rooms = sorted(by_room)
    for i in order:
        if sequence[i] >= 0:
            continue
        size = int(lengths[i])
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            r = rooms[at]
            s = by_room[r].pop()
            if not by_room[r]:
                del by_room[r], rooms[at]
        else:
            s, r = len(room), capacity
            room.append(capacity)
        sequence[i], offset[i] = s, capacity - r
        left = r - size
        if left not in by_room:
            by_room[left] = []
            bisect.insort(rooms, left)
        by_room[left].append(s)
    return sequence, offset


def _pack_shard(capacity: int):
    def pack_shard(rows: pa.Table) -> pa.Table:
        # An order of content, so that reruns agree.
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "length")])
        sequence, offset = pack(rows["length"].to_numpy(), capacity)
        shard = rows["shard"].to_numpy()
        rows = rows.drop_columns(["shard"])
        return rows.append_column("sequence_id", pa.array((shard << 32) + sequence)).append_column("offset", pa.array(offset))

    return pack_shard


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    shard_pieces: int = SHARD_PIECES, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    The pieces are written, then packed in shards of about ``shard_pieces`` that a hash of
    the written row deals out, so no task holds more, however many rows repeat. A shard's
    last sequences may stay open; of two thousand that is little. A null or empty text is a
    piece of one token; a null id stays null; rows that repeat are documents of their own;
    an empty table gives no rows. Other columns are not read.
    """
    cut = freeze(pieces(docs, tokenizer, capacity, end_id, id, text).withColumn("__row", F.monotonically_increasing_id()))
    shards = max(1, -(-cut.count() // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("__row"), F.lit(shards))).drop("__row")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), schema)
