"""Plain answers to compare with, on small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile("[0-9a-f]+"), 24),
]


def secrets(text):
    found = []
    for place, (kind, regex, least) in enumerate(BASE):
        for m in regex.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), place, m.end(), kind))
    return sorted(found)


def shingles(text, n):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def similar(rows, n, num, den):
    """{id: (size, smallest id reached)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in where[g] if j < i}:
            common = len(s & sets[j])
            if den * common >= num * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(rows, width=50):
    """[(id, bytes, removed, spans, digest)] of every row, by a table of all strings."""
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - width + 1):
                s = b[p : p + width]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - width + 1):
                if first[b[p : p + width]] < i:
                    gone[p : p + width] = b"\1" * width
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )
