"""Removal of byte strings that start in an earlier document, by suffix sorting.

A string of ``width`` bytes is named by the least hash among the shorter grams in it, so equal
strings have equal names and neighbouring strings mostly share one. A run of strings of one name
is a segment. The steps:

1. ``names_met``: which names occur in two documents or more. A task answers for the names
   that it meets twice itself and sends on one document a name, so no name is many rows.
2. ``segments``: the bytes of segments with such names, dealt out by name. A segment that a
   task meets in an earlier document is removed at once and sent on for its first document.
3. ``removals``: the segments of a shard, each different one once, are one text whose
   suffixes are sorted by external induction (``induced``). Suffixes next to each other with a
   common prefix of ``width`` or more are one string; all but those of its first document go.
4. The bytes covered are cut out of the texts.

What is shuffled are columns of many texts at once, packed (``packed``). Behind the names a text
is known by its id and its place among the texts of that id (``nth``), which is nearly always 0.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import as_bytes, map_batches
from weft.llm.induced import sorted_suffixes

WIDTH = 50
GRAM = 24  # three words of eight bytes
NAME_BYTES = 15  # a name comes about every so many bytes
# Bytes of one text that are named at a time; names of neighbouring pieces meet in the sort.
PIECE = 1 << 20
# Names, and bytes of segments, that a map task combines at a time.
CHUNK = 2_000_000
CHUNK_BYTES = 64 << 20
# Names of a reduce task. 32 bits of a name are told apart there: among some millions, few agree
# by chance, and that costs a look at their bytes and no result.
BUCKET = 3_000_000
SHARD_BYTES = 16 << 20
# Bytes of texts whose removed spans meet in one group.
SPAN_BYTES = 64 << 20
# Bytes of texts, or of segments, that are handled by one call.
STRETCH = 1 << 16
# Bytes of segments a byte of text has at the most: neighbours overlap.
OVERLAP = 3


def packed(*columns: np.ndarray) -> bytes:
    """Columns of integers as one compressed blob: of each, the bytes of one rank stand together."""
    raw = b"".join(
        [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    )
    return np.array([len(raw), *map(len, columns)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes, *types: type) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int64, 1 + len(types))
    raw = np.frombuffer(pa.decompress(blob[head.nbytes :], int(head[0]), codec="zstd"), np.uint8)
    columns, at = [], 0
    for n, t in zip(head[1:].tolist(), types):
        size = np.dtype(t).itemsize
        columns.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).reshape(n))
        at += n * size
    return columns


def _all_unpacked(blobs: list[bytes], *types: type) -> list[list[np.ndarray]]:
    """The columns of some blobs: for each column, one array a blob."""
    return [list(c) for c in zip(*(unpacked(b, *types) for b in blobs))] if blobs else [[] for _ in types]


def _concatenated(arrays: list[np.ndarray], type: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, type), *arrays])


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, the first one to 0; ``cumsum`` gives the values back."""
    return np.diff(values, prepend=values.dtype.type(0))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _sizes(cuts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(cuts, total))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _least_grams(data: np.ndarray) -> np.ndarray:
    """The least hash of the grams in each string."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = (x[:-shift] << np.uint64(8 * shift)) | x[shift:]
    grams = x[:-16] * np.uint64(0x9E3779B97F4A7C15)
    grams += x[8:-8] * np.uint64(0xD6E8FEB86659FD93)
    grams += x[16:] * np.uint64(0xC2B2AE3D27D4EB4F)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    # Windows of powers of two that cover a string.
    span, width = WIDTH - GRAM + 1, 1
    while 2 * width <= span:
        grams = np.minimum(grams[:-width], grams[width:])
        width *= 2
    if span > width:
        grams = np.minimum(grams[: -(span - width)], grams[span - width :])
    return grams


def named_runs(texts: list[bytes]) -> Iterator[tuple]:
    """The segments of some texts at a time, in order.

    First the texts joined and the number of the first of them; then, of each segment, its name, the
    number of its text, where it starts there, and where it starts and ends in the joined texts.
    """
    a = 0
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= STRETCH:
            size += len(texts[b])
            b += 1
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[a:b]])
        offsets = np.concatenate(([0], ends[:-1]))
        names, starts = [], []
        for begin in range(0, max(0, len(data) - WIDTH + 1), PIECE):
            least = _least_grams(data[begin : begin + PIECE + WIDTH - 1])
            first = _changes(least)
            inside = offsets[(offsets >= begin) & (offsets < begin + len(least))]
            first[inside - begin] = True
            first = np.flatnonzero(first)
            names.append(_mixed(least[first]))  # the least of some are not evenly spread
            starts.append(first + begin)
        name, start = _concatenated(names, np.uint64), _concatenated(starts, np.int64)
        which = np.searchsorted(offsets, start, side="right") - 1
        whole = start + WIDTH <= ends[which]
        name, start, which = name[whole], start[whole], which[whole]
        end = ends[which]
        same = which[1:] == which[:-1]
        end[:-1][same] = start[1:][same] + WIDTH - 1
        yield data, a, name, which + a, start - offsets[which], start, end
        a = b


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places that hold it."""
    if len(values) and 0 <= values.min() and values.max() < 1 << 16:
        values = values.astype(np.uint16)  # sorted by digits
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    cuts = np.flatnonzero(_changes(ordered))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(ordered[a]), order[a:b]


# names: names and their owners, packed: 32 bits a name; id, byte of the tag and number of names an
# owner. Of kind 2: id and tag of texts; the bucket is a group of documents.
_NAMES = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("names", pa.binary())])
_NAMED = (np.uint32, np.int64, np.uint8, np.uint32)
_TEXTS = (np.int64, np.int64)


def _codes(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each name in one number."""
    return ((names % np.uint64(buckets)) << np.uint64(32)) | (names >> np.uint64(32))


def _byte(tags: np.ndarray) -> np.ndarray:
    """What is kept of a tag beside each name: ids are mostly alone, and whole tags do not compress."""
    return (tags & 0xFF).astype(np.uint8)


def _owned(names: np.ndarray, owner: np.ndarray, docs: np.ndarray, subs: np.ndarray) -> bytes:
    """Names packed with their owners; those of one owner stand together."""
    cuts = np.flatnonzero(_changes(owner))
    whose = owner[cuts]
    counts = _sizes(cuts, len(owner)).astype(np.uint32)
    return packed(names.astype(np.uint32), _steps(docs[whose]), subs[whose], counts)


def _owners(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, the number of the owner of each, and the owners: id, byte of the tag."""
    names, docs, subs, counts = _all_unpacked(blobs, *_NAMED)
    counts = _concatenated(counts, np.uint32)
    docs = _concatenated([np.cumsum(d) for d in docs], np.int64)
    return _concatenated(names, np.uint32), np.repeat(np.arange(len(docs)), counts), docs, _concatenated(subs, np.uint8)


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """The place of each row in the order of these columns, the first one first; equal rows share one."""
    order = np.lexsort(columns[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(_changes(*(c[order] for c in columns))) - 1
    return out


def _names(buckets: int):
    def flush(found: list[tuple[np.ndarray, np.ndarray]], docs: np.ndarray, tags: np.ndarray) -> pa.RecordBatch:
        codes, owner = (np.concatenate(c) for c in zip(*found))
        subs = _byte(tags)
        # Owners come in order, so those of one name stay in order as well.
        order = np.argsort(codes, kind="stable")
        ordered = codes[order]
        fresh = np.flatnonzero(_changes(ordered, owner[order]))
        order, ordered = order[fresh], ordered[fresh]
        first = _changes(ordered)
        sizes = _sizes(np.flatnonzero(first), len(ordered))
        rows = []
        # kind 0: a name with one document, to be met with other tasks; 1: met here.
        for kind, some in ((0, first), (1, np.repeat(sizes > 1, sizes))):
            part = np.sort(order[some])
            for bucket, at in _groups(codes[part] >> np.uint64(32)):
                mine = part[at]
                rows.append((bucket, kind, _owned(codes[mine], owner[mine], docs, subs)))
        whose = np.flatnonzero(np.bincount(owner))
        for group, at in _groups(docs[whose] % buckets):
            rows.append((group, 2, packed(_steps(docs[whose[at]]), tags[whose[at]])))
        return _table(_NAMES, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs, tags, size, held = [], [], [], 0, 0
        for batch in batches:
            docs.append(batch["doc"].to_numpy())
            tags.append(batch["tag"].to_numpy())
            for _, _, names, which, *_ in named_runs(as_bytes(batch["text"])):
                found.append((_codes(names, buckets), which + held))
                size += len(names)
                if size >= CHUNK:
                    yield flush(found, np.concatenate(docs), np.concatenate(tags))
                    found, size = [], 0
            held += len(batch)
            if not found:
                docs, tags, held = [], [], 0
        if found:
            yield flush(found, np.concatenate(docs), np.concatenate(tags))

    return run


def _met(groups: int):
    def met(rows: pa.Table) -> pa.Table:
        """The names of a bucket that more than one entry has: a row for each group of documents."""
        bucket = rows["bucket"][0].as_py()
        kinds, blobs = rows["kind"].to_pylist(), rows["names"].to_pylist()
        first = [b for k, b in zip(kinds, blobs) if k == 0]
        n, o, docs, subs = _owners(first + [b for k, b in zip(kinds, blobs) if k == 1])
        alone = sum(int(np.frombuffer(b, np.int64, 2)[1]) for b in first)
        # Name and place in one number sort faster than places by name.
        keys = np.sort((n[:alone].astype(np.uint64) << np.uint64(32)) | np.arange(alone, dtype=np.uint64))
        short, at = keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        again = np.zeros(alone, bool)
        same = short[1:] == short[:-1]
        again[1:] |= same
        again[:-1] |= same
        some = np.concatenate((at[again], np.arange(alone, len(n))))
        n, o = n[some], o[some]
        order = np.argsort(_ranks(docs, subs)[o], kind="stable")
        n, o = n[order], o[order]
        out = [(group, 0, _owned(n[at], o[at], docs, subs)) for group, at in _groups(docs[o] % groups)]
        out += [(bucket, 2, b) for k, b in zip(kinds, blobs) if k == 2]
        return pa.Table.from_batches([_table(_MET, out)])

    return met


_MET = pa.schema([("group", pa.int64()), ("kind", pa.int32()), ("names", pa.binary())])


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that stand one behind the other in an array; ends in bytes."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def _by_document(rows: pa.Table) -> pa.Table:
    """``doc, tag, nth, met, whole``: 32 bits of the names met of each document of a group, and its
    place in its id. Texts of one id that share the byte of their tags are ``whole``: all their names
    count as met, so that none of them needs the names of the others."""
    kinds, blobs = rows["kind"].to_pylist(), rows["names"].to_pylist()
    docs, tags = _all_unpacked([b for k, b in zip(kinds, blobs) if k == 2], *_TEXTS)
    docs, tags = np.concatenate([np.cumsum(d) for d in docs]), np.concatenate(tags)
    order = np.lexsort((tags, _byte(tags), docs))
    order = order[_changes(docs[order], tags[order])]
    docs, tags = docs[order], tags[order]
    first = np.flatnonzero(_changes(docs))
    nth = np.arange(len(docs)) - np.repeat(first, _sizes(first, len(docs)))
    # Texts and owners by id and byte; the owners of each text's names, if any.
    n, o, whose, subs = _owners([b for k, b in zip(kinds, blobs) if k == 0])
    rank = _ranks(np.concatenate((docs, whose)), np.concatenate((_byte(tags), subs)))
    text, owner = rank[: len(docs)], rank[len(docs) :][o]
    order = np.argsort(owner, kind="stable")
    n, owner = n[order], owner[order]
    low, high = (np.searchsorted(owner, text, side=s) for s in ("left", "right"))
    some = high > low
    shared = np.bincount(text)[text] > 1
    high = np.where(shared, low, high)
    docs, tags, nth, low, high, shared = (c[some] for c in (docs, tags, nth, low, high, shared))
    names = _concatenated([n[a:b] for a, b in zip(low, high)], np.uint32)
    return pa.table(
        {
            "doc": pa.array(docs), "tag": pa.array(tags), "nth": pa.array(nth),
            "met": _binaries(names, 4 * np.cumsum(high - low)), "whole": pa.array(shared),
        }
    )


def names_met(docs: DataFrame, buckets: int) -> DataFrame:
    """``doc, tag, nth, met, whole``: of each document, its names that others may have as well."""
    dealt = map_batches(docs, _names(buckets), "bucket long, kind int, names binary")
    return (
        dealt.groupBy("bucket")
        .applyInArrow(_met(buckets), "group long, kind int, names binary")
        .groupBy("group")
        .applyInArrow(_by_document, "doc long, tag long, nth long, met binary, whole boolean")
    )


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of these stretches of data, one behind the other."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    a = 0
    while a < len(starts):
        begin = int(ends[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + STRETCH, side="right")))
        shift = starts[a:b] - (ends[a:b] - lengths[a:b])
        out[begin : ends[b - 1]] = data[np.arange(begin, ends[b - 1]) + np.repeat(shift, lengths[a:b])]
        a = b
    return out


_BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


def digests(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each body; the bodies stand one behind the other in data."""
    ends = np.cumsum(lengths)
    longest = int(max(STRETCH, lengths.max(initial=0)))
    up, down = _powers(_BASE, longest), _powers(pow(_BASE, -1, 1 << 64), longest)
    out = np.empty(len(lengths), np.uint64)
    a = 0
    while a < len(lengths):
        begin = int(ends[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + STRETCH, side="right")))
        part = data[begin : ends[b - 1]]
        at = ends[a:b] - lengths[a:b] - begin
        out[a:b] = np.add.reduceat(part * up[: len(part)], at) * down[at]
        a = b
    return _mixed(out + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def classes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each body, the same for equal ones. Bodies of one hash are compared."""
    starts = np.cumsum(lengths) - lengths
    _, place, which = np.unique(digests(data, lengths), return_index=True, return_inverse=True)
    theirs = place[which]
    others = np.flatnonzero(theirs != np.arange(len(which)))
    theirs = theirs[others]
    if not (lengths[others] == lengths[theirs]).all() or not np.array_equal(
        gathered(data, starts[others], lengths[others]), gathered(data, starts[theirs], lengths[theirs])
    ):  # two bodies of one hash
        seen: dict[bytes, int] = {}
        blob = data.tobytes()
        return np.array([seen.setdefault(blob[a : a + n], len(seen)) for a, n in zip(starts.tolist(), lengths.tolist())])
    return which


def _earliest(which: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each body, the smallest document of its class."""
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(_changes(which[order]))
    out = np.empty(len(docs), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(docs[order], cuts), _sizes(cuts, len(docs)))
    return out


# kind 0: segments of a shard: id, length, number of places and 32 bits of the name a body, nth and
# start a place, the bodies. kind 1: spans removed: id, nth, start, length. kind 2: id, nth, tag of
# texts. For the latter two, the shard is a group of documents.
_SEGMENTS = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
_BODIES = (np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8)
_SPANS = (np.int64, np.uint32, np.uint32, np.uint32)
_TAGS = (np.int64, np.uint32, np.int64)


def _by_group(spans: list[np.ndarray], groups: int) -> Iterator[tuple[int, bytes]]:
    """Spans (doc, nth, start, end), joined and packed, for each group of documents."""
    if sum(map(len, spans)):
        joined = _joined(np.concatenate(spans))
        for group, at in _groups(joined[:, 0] % groups):
            doc, nth, start, end = joined[at].T
            yield group, packed(_steps(doc), nth.astype(np.uint32), start.astype(np.uint32), (end - start).astype(np.uint32))


def _segments(shards: int, groups: int):
    def flush(found: list[tuple], texts: list[tuple]) -> pa.RecordBatch:
        """One row a shard with its segments one behind the other, spans that are removed, and the texts."""
        names, docs, nth, starts, lengths, data = (np.concatenate(c) for c in zip(*found))
        which = classes(data, lengths)
        least = _earliest(which, docs)
        later = docs > least
        gone = np.stack((docs, nth, starts, starts + lengths), axis=1)[later]
        rows = [(group, 1, blob) for group, blob in _by_group([gone], groups)]
        doc, tag, rank = (np.concatenate(c) for c in zip(*texts))
        for group, some in _groups(doc % groups):
            rows.append((group, 2, packed(_steps(doc[some]), rank[some].astype(np.uint32), tag[some])))
        # The places of a body, by shard and by where the body was met first.
        at = np.flatnonzero(~later)
        first = np.full(which.max() + 1, len(which))
        np.minimum.at(first, which[at], at)
        place = first[which[at]]
        shard = (names[place] % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((place, shard))
        at, place, shard = at[order], place[order], shard[order]
        offsets = np.cumsum(lengths) - lengths
        cuts = np.flatnonzero(_changes(shard))
        for a, b in zip(cuts, [*cuts[1:], len(at)]):
            heads = np.flatnonzero(_changes(place[a:b]))
            body = place[a:b][heads]
            rows.append(
                (int(shard[a]), 0, packed(
                    _steps(docs[body]), lengths[body].astype(np.uint32), _sizes(heads, b - a).astype(np.uint32),
                    (names[body] >> np.uint64(32)).astype(np.uint32), nth[at[a:b]].astype(np.uint32),
                    starts[at[a:b]].astype(np.uint32), gathered(data, offsets[body], lengths[body]),
                ))
            )
        return _table(_SEGMENTS, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts, size = [], [], 0
        for batch in batches:
            docs, tags, nth = (batch[c].to_numpy() for c in ("doc", "tag", "nth"))
            texts.append((docs, tags, nth))
            met = [np.frombuffer(m, np.uint32) for m in batch["met"].to_pylist()]
            whole = np.array(batch["whole"].to_pylist(), bool)
            for data, a, names, which, starts, begin, end in named_runs(as_bytes(batch["text"])):
                if not len(names):
                    continue
                some = met[a : which[-1] + 1]
                wanted = np.repeat(np.arange(a, a + len(some), dtype=np.uint64) << np.uint64(32), [len(m) for m in some])
                wanted |= np.concatenate(some)
                met_here = np.isin((which.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)), wanted)
                at = np.flatnonzero(met_here | whole[which])
                # A long text is taken in parts.
                for k in range(0, len(at), STRETCH):
                    part = at[k : k + STRETCH]
                    lengths = end[part] - begin[part]
                    mine = which[part]
                    found.append((names[part], docs[mine], nth[mine], starts[part], lengths, gathered(data, begin[part], lengths)))
                    size += int(lengths.sum()) + 40 * len(part)
                    if size >= CHUNK_BYTES:
                        yield flush(found, texts)
                        found, texts, size = [], [(docs, tags, nth)], 0
        if found:
            yield flush(found, texts)

    return run


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans (doc, nth, start, end) sorted, with those of one text that touch as one."""
    spans = spans[np.lexsort((spans[:, 3], spans[:, 2], spans[:, 1], spans[:, 0]))]
    change = np.concatenate(([True], (spans[1:, :2] != spans[:-1, :2]).any(axis=1)))
    # The reach of a span counts within its text: each text's ends are lifted above those before.
    lift = (np.cumsum(change) - 1) << 40
    reach = np.maximum.accumulate(spans[:, 3] + lift)
    first = np.concatenate(([True], spans[1:, 2] + lift[1:] > reach[:-1]))
    cuts = np.flatnonzero(first)
    out = spans[cuts].copy()
    out[:, 3] = np.concatenate((reach[cuts[1:] - 1], reach[-1:])) - lift[cuts]
    return out


def strings_met(data: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (body, start, end) that are covered by strings of ``WIDTH`` bytes which a body of an
    earlier document holds. The bodies stand one behind the other in data."""
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.ones(len(data) + len(lengths), np.uint16)  # a symbol below all bytes ends each body
    text[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data.astype(np.uint16) + 2
    marks = []

    def settle(at: np.ndarray, lcp: np.ndarray) -> None:
        owner = np.searchsorted(starts, at, side="right") - 1
        whole = at + WIDTH <= starts[owner] + lengths[owner]
        # Strings that are equal stand together; none that is cut off stands between.
        cuts = np.flatnonzero(lcp < WIDTH)
        earliest = np.minimum.reduceat(np.where(whole, docs[owner], np.iinfo(np.int64).max), cuts)
        least = np.repeat(earliest, np.diff(np.concatenate((cuts, [len(at)]))))
        marks.append(at[whole & (docs[owner] > least)])

    with tempfile.TemporaryDirectory(prefix="weft-suffixes-") as folder:
        # Spill files of this task alone, gone when it ends.
        held_at, held_lcp = [], []
        for at, lcp in sorted_suffixes(text, WIDTH, folder):
            lcp = lcp.copy()
            if not held_at:
                lcp[:1] = 0
            cuts = np.flatnonzero(lcp < WIDTH)
            if held_at and len(cuts):
                settle(np.concatenate([*held_at, at[: cuts[0]]]), np.concatenate([*held_lcp, lcp[: cuts[0]]]))
                at, lcp = at[cuts[0] :], lcp[cuts[0] :]
                held_at, held_lcp = [], []
            held_at.append(at)
            held_lcp.append(lcp)
        if held_at:
            settle(np.concatenate(held_at), np.concatenate(held_lcp))
    found = np.sort(_concatenated(marks, np.int64))
    owner = np.searchsorted(starts, found, side="right") - 1
    first = _changes(owner)
    first[1:] |= found[1:] > found[:-1] + WIDTH
    cuts = np.flatnonzero(first)
    last = np.append(cuts[1:], len(found)) - 1
    return owner[cuts], found[cuts] - starts[owner[cuts]], found[last[: len(cuts)]] + WIDTH - starts[owner[cuts]]


_GONE = pa.schema([("group", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _spans(blobs: list[bytes]) -> np.ndarray:
    docs, nth, starts, lengths = _all_unpacked(blobs, *_SPANS)
    parts = [np.stack((np.cumsum(d), n, s, s + size.astype(np.int64)), axis=1) for d, n, s, size in zip(docs, nth, starts, lengths)]
    return np.concatenate([np.zeros((0, 4), np.int64), *parts])


def _remove(groups: int):
    def remove(rows: pa.Table) -> pa.Table:
        """The removed spans of a shard, packed: a row for each group of documents."""
        kinds, blobs = rows["kind"].to_pylist(), rows["data"].to_pylist()
        out = [(key, 2, b) for key, k, b in zip(rows["shard"].to_pylist(), kinds, blobs) if k == 2]
        gone = [_spans([b for k, b in zip(kinds, blobs) if k == 1])]
        columns = _all_unpacked([b for k, b in zip(kinds, blobs) if k == 0], *_BODIES)
        docs = _concatenated([np.cumsum(d) for d in columns[0]], np.int64)
        if len(docs):
            lengths, counts = (_concatenated(c, np.int64) for c in columns[1:3])
            names, data = _concatenated(columns[3], np.uint32), _concatenated(columns[6], np.uint8)
            nth, starts = (_concatenated(c, np.int64) for c in columns[4:6])
            which = classes(data, lengths)
            later = docs > _earliest(which, docs)
            body = np.repeat(np.arange(len(docs)), counts)  # of each place
            some = later[body]
            gone.append(np.stack((docs[body], nth, starts, starts + lengths[body]), axis=1)[some])
            # Equal strings have one name: only a name's different segments, of two documents or
            # more, can share some of their strings. One body of each class stands for it.
            kept = np.flatnonzero(~later)
            heads = kept[np.unique(which[kept], return_index=True)[1]]
            heads = heads[np.lexsort((docs[heads], names[heads]))]
            first = np.flatnonzero(_changes(names[heads]))
            sizes = _sizes(first, len(heads))
            heads = heads[np.repeat(docs[heads[first]] != docs[heads[first + sizes - 1]], sizes)]
            if len(heads):
                offsets = np.cumsum(lengths) - lengths
                owner, begin, end = strings_met(gathered(data, offsets[heads], lengths[heads]), lengths[heads], docs[heads])
                # Each run at all places of its class.
                at = np.flatnonzero(~some)
                at = at[np.argsort(which[body[at]], kind="stable")]
                theirs = which[body[at]]
                low, high = (np.searchsorted(theirs, which[heads[owner]], side=s) for s in ("left", "right"))
                times = high - low
                run = np.repeat(np.arange(len(owner)), times)
                place = at[np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times) + low[run]]
                gone.append(np.stack((docs[body[place]], nth[place], starts[place] + begin[run], starts[place] + end[run]), axis=1))
        out += [(group, 1, blob) for group, blob in _by_group(gone, groups)]
        return pa.Table.from_batches([_table(_GONE, out)])

    return remove


def _spans_by_document(rows: pa.Table) -> pa.Table:
    """``doc, tag, spans``: the maximal removed runs (start, end) of each document of a group."""
    kinds, blobs = rows["kind"].to_pylist(), rows["data"].to_pylist()
    spans = _spans([b for k, b in zip(kinds, blobs) if k == 1])
    if not len(spans):
        return pa.table({"doc": pa.array([], pa.int64()), "tag": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
    spans = _joined(spans)
    cuts = np.flatnonzero(_changes(spans[:, 0], spans[:, 1]))
    # Each text of spans comes behind the entry that knows its tag.
    docs, nth, tags = _all_unpacked([b for k, b in zip(kinds, blobs) if k == 2], *_TAGS)
    doc = np.concatenate([*map(np.cumsum, docs), spans[cuts, 0]])
    nth = np.concatenate([*nth, spans[cuts, 1]]).astype(np.int64)
    tag = np.concatenate([*tags, np.zeros(len(cuts), np.int64)])
    asks = np.arange(len(doc)) >= len(doc) - len(cuts)
    order = np.lexsort((asks, nth, doc))
    here = np.flatnonzero(asks[order])
    ends = 16 * np.append(cuts[1:], len(spans))
    return pa.table(
        {
            "doc": pa.array(spans[cuts, 0]), "tag": pa.array(tag[order[here - 1]]),
            "spans": _binaries(spans[:, 2:], ends),
        }
    )


_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
     ("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def _cut(keep: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"]), batch["spans"].to_pylist()):
                runs = np.frombuffer(spans or b"", np.int64).reshape(-1, 2)
                at, kept = 0, []
                for start, end in runs.tolist():
                    kept.append(text[at:start])
                    at = end
                left = b"".join([*kept, text[at:]])
                rows.append(
                    (doc, len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left if keep else None)
                )
            yield _table(_RESULT, rows)

    return cut


def remove_repeats(docs: DataFrame, keep: bool = True, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row.

    Every byte that is covered by a string of 50 bytes which also starts in a document of a
    smaller id is removed; strings overlap, end with their document, and are judged on the
    input. ``kept`` holds the bytes left, null if not asked for: a cut may split a character.

    A null text counts as empty. A row without id comes neither before nor after another:
    nothing is removed from it or for it. Rows of one id are one place in the order and take
    nothing from each other. Texts of fewer than 50 bytes stay. An empty table gives no
    rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # The tag tells apart rows that share an id and not the text; rows without id have one below 0.
    # Both joins below are on these two, which are never null, and need no other column than the
    # text, so their plans begin alike and the texts are shuffled once.
    mark = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), body.alias("text")).select(
        "text",
        F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc"),
        F.when(F.col("doc_id").isNull(), -1 - mark).otherwise(mark).alias("tag"),
    )
    long = rows.filter((F.col("tag") >= 0) & (F.octet_length("text") >= WIDTH))
    size = long.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    buckets, shards = max(1, -(-size // (NAME_BYTES * BUCKET))), max(1, -(-OVERLAP * size // SHARD_BYTES))
    groups = max(1, -(-size // SPAN_BYTES))
    keys = ["doc", "tag"]
    met = names_met(long.select("doc", "tag", "text"), buckets)
    dealt = map_batches(
        rows.join(met, keys, "left").filter("met IS NOT NULL").select("doc", "tag", "nth", "text", "met", "whole"),
        _segments(shards, groups), "shard long, kind int, data binary",
    )
    gone = (
        dealt.groupBy("shard")
        .applyInArrow(_remove(groups), "group long, kind int, data binary")
        .groupBy("group")
        .applyInArrow(_spans_by_document, "doc long, tag long, spans binary")
    )
    return map_batches(
        rows.join(gone, keys, "left").select(F.when(F.col("tag") >= 0, F.col("doc")).alias("doc_id"), "text", "spans"),
        _cut(keep),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
