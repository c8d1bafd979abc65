"""The conversation prefix trie against a plain trie."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from weft.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, chars int, pos int"


def rebuilt(rows):
    """{conv_id: [(role, text)]} by the contract."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), tie, role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(rows):
    paths = rebuilt(rows)
    members, ends = {}, {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * len(node[-1][1] if node else "")
    return sorted(
        (
            min(who), len(node), min(members[node[:-1]]) if node else -1, len(who), len(kids.get(node, [])), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        )
        for node, who in members.items()
    )


def found(spark, rows, block=trie.BLOCK):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    own = F.col("conv_id")
    got = trie.prefix_trie(*trie.rebuild(trie.numbered_turns(table), own - own % 100, F.crc32(own.cast("string")) % 6, 5), block)
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


def some_rows(seed=1):
    rng = random.Random(seed)
    said = [("user", "hi"), ("assistant", "oh"), ("user", None), (None, "é😀"), ("u", "serhi")]
    rows = []
    for c in [0, 1, 2, 3, 4, 5, 7, 99, 100, 150, 151, 201, 205, 206, 900, -3, -150, 1 << 40]:
        n = rng.choice([1, 2, 3, 4, 9])
        rows += [(c, rng.choice([k, k, k, None, 0]), *rng.choice(said[:3] if k < 2 else said)) for k in range(n)]
    rows += [(c, k, "user", "same") for c in range(1000, 1030) for k in range(6)]
    rows += [(2000, k, "user", str(k % 3)) for k in range(70)] + [(2001, k, "user", str(k % 3)) for k in range(75)]
    rows += [(None, 1, "user", "lost"), (5, 3, "user", "twice"), (5, 3, "user", "twice")]
    return rows


@pytest.mark.parametrize("block", [3, 8])
def test_nodes_equal_a_plain_trie(spark, block):
    rows = some_rows(block)
    assert found(spark, rows, block) == plain(rows)


def test_long_conversations_in_spans(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN_BITS", 2)
    rows = some_rows(11)
    assert found(spark, rows, 3) == plain(rows)


def test_a_conversation_with_most_rows_is_cut(spark):
    rows = [(7, k, "user", f"turn {k // 2}") for k in range(3000)] + [(8, 0, "user", "turn 0")]
    assert found(spark, rows) == plain(rows)


def test_turnless_and_empty(spark):
    # 130 has five turns at most and begins with those of a conversation that is not there.
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(lone, 0, "user", "gone"), (None, 0, "user", "x")]
    assert found(spark, rows) == plain(rows) == [(lone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert found(spark, []) == []


def test_sql_agrees(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = queries.op12_trie(spark, sf_dir)
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP12_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
