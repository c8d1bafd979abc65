"""Suffix sorting by external induction, with common prefixes up to a limit.

Suffixes are of type S if smaller than the next one and of type L if larger. The leftmost S
suffixes of each run are sorted first; the order of all L suffixes follows from them in one
ascending pass, and that of all S suffixes from the L suffixes in one descending pass. A pass
takes suffixes from queues, one a first symbol, and pushes the suffix before each of them; as
suffixes come in order, a queue is filled in order, so the queues together are a priority
queue by symbol and rank. Entries carry the common prefix with the entry before them: one
more than the least of the common prefixes met since the last entry of the same queue.

Queues live in files; beside the text, with four bytes and a type a symbol, only batches of
them and the last entries of each are in memory. Suffixes that agree for ``limit`` symbols may come in any order.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np

BATCH = 1 << 18
# Starts that are sorted in memory, with two bytes a symbol of the limit; more are sorted in runs and merged.
RUN = 1 << 20
# Entries that wait in memory for one queue until they are written.
WAITING = 1 << 12

_ENTRY = np.dtype([("at", np.int64), ("lcp", np.int32)])


class DiskQueue:
    """Entries in order of arrival: a file, and the last ones in memory. What was taken can be read again."""

    def __init__(self, path: str):
        self.path, self.read, self.written = path, 0, 0
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        rows = np.empty(len(at), _ENTRY)
        rows["at"], rows["lcp"] = at, lcp
        self.waiting.append(rows)
        self.held += len(rows)
        if self.held >= WAITING:
            with open(self.path, "ab") as out:
                for part in self.waiting:
                    out.write(part.tobytes())
            self.written += self.held
            self.waiting, self.held = [], 0

    def _entries(self, begin: int, end: int) -> np.ndarray:
        """Entries that are all in the file or all in memory."""
        if begin < self.written:
            with open(self.path, "rb") as source:
                source.seek(begin * _ENTRY.itemsize)
                return np.fromfile(source, _ENTRY, end - begin)
        self.waiting = [np.concatenate(self.waiting)]
        return self.waiting[0][begin - self.written : end - self.written]

    def take(self) -> np.ndarray | None:
        """The next entries, at most a batch; None if there are none now."""
        end = self.written if self.read < self.written else self.written + self.held
        if self.read == end:
            return None
        rows = self._entries(self.read, min(end, self.read + BATCH))
        self.read += len(rows)
        return rows

    def _taken(self) -> list[tuple[int, int]]:
        """All entries that were ever taken, in batches."""
        file = min(self.read, self.written)
        cuts = [*range(0, file, BATCH), *range(file, self.read, BATCH), self.read]
        return list(zip(cuts, cuts[1:]))

    def descending(self) -> Iterator[np.ndarray]:
        """All entries that were ever taken, in batches from the last one."""
        for begin, end in reversed(self._taken()):
            yield self._entries(begin, end)[::-1]

    def ascending(self) -> Iterator[np.ndarray]:
        for begin, end in self._taken():
            yield self._entries(begin, end)


class _Pass:
    """One pass of induction: queues by symbol, and the least common prefix since their last entry."""

    def __init__(self, text: np.ndarray, pushes: np.ndarray, symbols: int, limit: int, folder: str, name: str):
        self.text, self.pushes, self.limit = text, pushes, limit
        self.queues = [DiskQueue(os.path.join(folder, f"{name}{c}")) for c in range(symbols)]
        # -1: nothing was pushed yet, so there is no entry to have a common prefix with.
        self.least = np.full(symbols, -1, np.int64)

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Push the suffix before each of these, which come next in the order of the pass."""
        before = at - 1
        valid = (at > 0) & self.pushes[before]
        target = np.where(valid, self.text[before], -1)
        lcp = lcp.astype(np.int64)
        touched = np.unique(target[valid])
        kept = self.least.copy()
        for c in touched.tolist():
            where = np.flatnonzero(target == c)
            cuts = np.concatenate(([0], where[:-1] + 1))
            # Each range runs to its entry; the last one would run to the end of the batch.
            lows = np.minimum.reduceat(lcp[: where[-1] + 1], cuts)
            lows[0] = -1 if kept[c] < 0 else min(lows[0], kept[c])
            self.queues[c].push(before[where], np.minimum(lows + 1, self.limit))
            rest = lcp[where[-1] + 1 :]
            self.least[c] = rest.min() if len(rest) else self.limit
        others = np.ones(len(self.least), bool)
        others[touched] = False
        others &= self.least >= 0
        if len(lcp):
            self.least[others] = np.minimum(self.least[others], lcp.min())


def _types(text: np.ndarray) -> np.ndarray:
    """True for S. The text ends in a symbol smaller than all others, which is S."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    smaller = text[change] < text[change + 1]
    types = np.ones(n, bool)
    types[: n - 1] = np.repeat(smaller, np.diff(np.concatenate(([-1], change))))[: n - 1]
    return types


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, up to the limit."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    whole = (a + limit < n) & (b + limit < n)
    if len(a) > 1 and whole.any():
        some = np.flatnonzero(whole)
        windows = np.lib.stride_tricks.sliding_window_view(text, limit)
        for begin in range(0, len(some), 1 << 14):
            part = some[begin : begin + (1 << 14)]
            differ = windows[a[part]] != windows[b[part]]
            out[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), limit)
        going = np.flatnonzero(~whole)
    for k in range(limit):
        x, y = a[going] + k, b[going] + k
        inside = (x < n) & (y < n)
        same = inside.copy()
        same[inside] = text[x[inside]] == text[y[inside]]
        going = going[same]
        if not len(going):
            break
        out[going] += 1
    return out


def _sorted_starts(text: np.ndarray, starts: np.ndarray, limit: int, folder: str) -> Iterator[np.ndarray]:
    """The starts sorted by ``limit`` symbols: runs sorted in memory, written, and merged."""
    # Big-endian symbols compare as their bytes do; behind the end stand zeros.
    padded = np.concatenate((text, np.zeros(limit, text.dtype))).astype(">u2")
    windows = np.lib.stride_tricks.sliding_window_view(padded, limit)
    size = 2 * limit
    runs = []
    for begin in range(0, len(starts), RUN):
        part = starts[begin : begin + RUN]
        keys = windows[part].view(f"S{size}").reshape(-1)
        order = np.argsort(keys, kind="stable")
        if len(starts) <= RUN:
            yield part[order]
            return
        path = os.path.join(folder, f"run{begin}")
        keys[order].tofile(path + ".keys")
        part[order].tofile(path)
        runs.append((path, len(part)))

    def rows(path: str, count: int) -> Iterator[tuple[bytes, int]]:
        step = max(1, BATCH // 16)
        with open(path + ".keys", "rb") as keys, open(path, "rb") as at:
            for _ in range(0, count, step):
                some = np.fromfile(at, np.int64, step)
                blob = keys.read(len(some) * size)
                for i, p in enumerate(some.tolist()):
                    yield blob[i * size : (i + 1) * size], p

    batch: list[int] = []
    for _, p in heapq.merge(*[rows(*run) for run in runs]):
        batch.append(p)
        if len(batch) >= BATCH:
            yield np.array(batch, np.int64)
            batch = []
    if batch:
        yield np.array(batch, np.int64)


def sorted_suffixes(text: np.ndarray, limit: int, folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in order with their common prefix with the one before, in batches.

    ``text``: symbols from 1 to 511 as unsigned 16-bit numbers; a final 0 is added here. The order and the
    common prefixes are those of the first ``limit`` symbols.
    """
    text = np.concatenate((text.astype(np.uint16), np.zeros(1, np.uint16)))
    types = _types(text)
    symbols = int(text.max()) + 1
    lms = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    # The sorted leftmost S suffixes wait in a queue for each symbol, with common prefixes.
    first = [DiskQueue(os.path.join(folder, f"lms{c}")) for c in range(symbols)]
    last = None
    for part in _sorted_starts(text, lms, limit, folder):
        before = np.concatenate((part[:1] if last is None else [last], part[:-1]))
        common = _common(text, before, part, limit)
        last = part[-1]
        heads = text[part]
        for c in np.unique(heads).tolist():
            where = heads == c
            first[c].push(part[where], common[where])

    def seam(a: int | None, b: int) -> int:
        return 0 if a is None else int(_common(text, np.array([a]), np.array([b]), limit)[0])

    def drain(queue: DiskQueue, into: _Pass, previous: int | None) -> int | None:
        """Take all entries of a queue, those that it gets meanwhile included."""
        begun = False
        while (rows := queue.take()) is not None:
            at, lcp = rows["at"], rows["lcp"].astype(np.int64)
            if not begun:
                lcp[0] = seam(previous, int(at[0]))
                begun = True
            previous = int(at[-1])
            into.feed(at, lcp)
        return previous

    ascending = _Pass(text, ~types, symbols, limit, folder, "l")
    for c in range(symbols):
        previous = drain(ascending.queues[c], ascending, None)
        drain(first[c], ascending, previous)

    descending = _Pass(text, types, symbols, limit, folder, "s")
    for c in range(symbols - 1, 0, -1):
        previous = drain(descending.queues[c], descending, None)
        ahead = None
        for rows in ascending.queues[c].descending():
            at = rows["at"]
            # Going down, an entry's common prefix is that of the entry met before it.
            lcp = np.concatenate(([seam(previous, int(at[0])) if ahead is None else ahead], rows["lcp"][:-1]))
            ahead = rows["lcp"][-1]
            descending.feed(at, lcp)

    # The end alone begins with 0.
    yield np.array([len(text) - 1]), np.array([0])
    for c in range(1, symbols):
        previous = None
        for rows in ascending.queues[c].ascending():
            previous = int(rows["at"][-1])
            yield rows["at"], rows["lcp"].astype(np.int64)
        ahead = None
        # The S suffixes came from the largest; their order and common prefixes turn round.
        for rows in descending.queues[c].descending():
            start = seam(previous, int(rows["at"][0])) if ahead is None else ahead
            yield rows["at"], np.concatenate(([start], rows["lcp"][:-1].astype(np.int64)))
            ahead = int(rows["lcp"][-1])
