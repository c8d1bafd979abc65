"""Spelling variants against all words one edit apart, found by their forms without a letter."""

from __future__ import annotations

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from weft.llm import queries, spelling


def counts_of(rows):
    out = {}
    lower = {i: i + 32 for i in range(65, 91)}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] = out.get(w, 0) + 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """{word: (form, root, n, n_near, form_n)} by comparing all pairs."""
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_words_of_texts(spark, docs, texts, no_docs):
    rows = texts + [(70, "Thanedble, THANEDBLE thanedblé" + " thanedble" * 40), (71, "Ñandúes ñandúes ÑANDúes × straßen×÷ straßen×÷"), (72, "a" * 3000 + " " + "a" * 3000)]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(3)
    assert found(spelling.variants(spelling.word_counts(table))) == plain(counts_of(rows))
    assert found(spelling.variants(spelling.word_counts(no_docs))) == {}


def test_pieces_of_long_texts(monkeypatch):
    text = "thanedble éaueaux-x " * 50
    whole = [w for part in spelling._runs(text) for w in part]
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert [w for part in spelling._runs(text) for w in part] == whole == ["thanedble", "éaueaux"] * 50


def variants_of(rng, letters, sizes, n):
    words = {}
    while len(words) < n:
        base = [rng.choice(letters) for _ in range(rng.choice(sizes))]
        for _ in range(4):
            w = list(base)
            k = rng.randrange(len(w))
            kind = rng.random()
            if kind < 0.3:
                w[k] = rng.choice(letters)
            elif kind < 0.6:
                w.insert(k, rng.choice(letters))
            elif kind < 0.9:
                del w[k]
            words["".join(w)] = 2 * 10 ** rng.randrange(5)
    return words


@pytest.mark.parametrize("letters, sizes", [("abcdefghijklmnopqrstuvwxyzéèßñ", [7, 8, 9]), ("ab", [9, 10]), ("aéí", [8, 30])])
def test_cells_parts_and_large_classes(spark, monkeypatch, letters, sizes):
    """Small bounds, so that lengths are cut into cells, cells into parts, and classes are looked up."""
    for name, value in (("CELL", 24), ("SAMPLE", 200), ("LARGE_CLASS", 3), ("LEAF", 2), ("PAIRS", 8)):
        monkeypatch.setattr(spelling, name, value)
    monkeypatch.setattr(spelling, "capacity", lambda length: 24)
    rng = random.Random(len(letters))
    words = variants_of(rng, letters, sizes, 500)
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert found(spelling.variants(table)) == plain(words)


def test_trees_leave_out_no_neighbour():
    rng = random.Random(3)
    words = sorted(w for w in variants_of(rng, "abcdeé", [7, 8], 900))
    latin = {size: [w.encode("latin-1") for w in words if len(w) == size] for size in (7, 8)}
    for size, other in ((7, 8), (8, 7), (8, 8)):
        tree = spelling.Tree(latin[size], [1] * len(latin[size]))
        mine, its = tree.near(latin[other])
        got = sorted((latin[other][a].decode("latin-1"), tree.words[b].decode("latin-1")) for a, b in zip(mine, its))
        assert got == sorted((a, b) for a in words if len(a) == other for b in words if len(b) == size and one_edit(a, b))
        upper = spelling.Cells(spelling.letter_counts(latin[size]), 9)
        home = dict(zip(latin[size], spelling.Router({size: upper}).homes(latin[size]) & 0xFFFFF))
        up, down = (1, 1) if size == other else (1, 0) if other < size else (0, 1)
        row, leaf = upper.reached(spelling.letter_counts(latin[other]), up, down)
        reached = set(zip(row.tolist(), leaf.tolist()))
        assert all((a, home[tree.words[b]]) in reached for a, b in zip(mine.tolist(), its.tolist()))


def test_counts_beyond_a_byte():
    long, longer = b"a" * 600, b"a" * 300 + b"b" + b"a" * 300
    assert spelling.letter_counts([long, longer])[:, 0].tolist() == [255, 255]
    tree = spelling.Tree([long, b"a" * 599 + b"c"], [5, 5])
    assert sorted(tree.near([longer])[1].tolist()) == [0]
    assert sorted(tree.near([long])[1].tolist()) == [1]
    assert spelling.one_edit(np.array([[1, 2, 3]]), np.array([[1, 3, 2, 3]])).tolist() == [True]


def test_sql_agrees(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.op11_spelling(spark, sf_dir)
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP11_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected)) and expected
