"""Vocabularies and encoding."""

from collections import Counter

import numpy as np
import pytest

from weft.functions import text
from weft.operators import vocabulary as op
from pyspark.sql import functions as F


def tokens_of(spark, lines):
    rows = [(i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "line_no bigint, line string").select(
        "line_no", F.posexplode(text.split_space("line")).alias("pos", "token")
    )


def listing(vocab):
    return [r["token"] for r in vocab.orderBy("id").collect()]


def test_golden(spark):
    vocab = op.build_vocab(tokens_of(spark, ["the the UNK x"]))
    assert listing(vocab) == ["<null>", "<s>", "</s>", "UNK", "the", "UNK", "x"]
    ids = {r["token"]: r["id"] for r in op.lookup(vocab).collect()}
    assert ids["UNK"] == 5 and ids["the"] == 4
    assert op.size(vocab).first()["size"] == 7


def by_rule(lines, limit, specials=4):
    counter = Counter()
    for line in lines:
        counter.update(line.split(" "))
    first = {token: i for i, token in enumerate(counter)}
    best = sorted(counter, key=lambda t: (-counter[t], first[t]))[: limit - specials]
    return sorted(best, key=lambda t: (-counter[t], t))


@pytest.mark.parametrize("limit", [4, 5, 6, 7, 9, 30])
def test_limit_keeps_first_occurrences(spark, limit):
    lines = ["z y x", "a z b", "", "c  y d", "e f z"]
    vocab = op.build_vocab(tokens_of(spark, lines), limit=limit, order=["line_no", "pos"])
    assert listing(vocab)[4:] == by_rule(lines, limit)


def test_limit_inside_a_large_tie(spark):
    lines = [" ".join(f"w{(7 * i + k) % 400:03d}" for k in range(3)) for i in range(200)] + ["top top w001"]
    for limit in (4, 5, 6, 8, 100, 205, 404, 405, 500):
        vocab = op.build_vocab(tokens_of(spark, lines), limit=limit, order=["line_no", "pos"])
        assert listing(vocab)[4:] == by_rule(lines, limit)


def test_limit_below_reserved_tokens(spark):
    with pytest.raises(ValueError):
        op.build_vocab(tokens_of(spark, ["a"]), limit=3, order=["line_no"])


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_encode_and_decode_broadcast_and_shuffled(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(op, "BROADCAST_BYTES", broadcast_bytes)
    lines = ["a b b c", "d a zzz", "", "b"]
    vocab = op.build_vocab(tokens_of(spark, lines[:1] + ["d d d"]))
    ids = {t: i for i, t in enumerate(listing(vocab))}
    rows = spark.createDataFrame([(i, line.split()) for i, line in enumerate(lines)], "line_no bigint, tokens array<string>")
    coded = op.encode(rows, vocab, ["line_no"])
    found = {r["line_no"]: r["ids"] for r in coded.collect()}
    assert found == {i: [ids.get(t, 3) for t in line.split()] for i, line in enumerate(lines)}
    back = {r["line_no"]: r["tokens"] for r in op.decode(coded, vocab, ["line_no"]).collect()}
    assert back == {i: [t if t in ids else "UNK" for t in line.split()] for i, line in enumerate(lines)}


@pytest.mark.parametrize("chunk_bytes", [8, 1 << 20])
def test_translate_meets_the_dictionary_by_distinct_tokens(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(op, "CHUNK_BYTES", chunk_bytes)
    schema = "k string, n bigint, tokens array<string>"
    rows = spark.createDataFrame(
        [("x", 0, ["b", "a", "b"]), ("x", 0, ["a", "c"]), (None, None, ["a", None]), ("y", None, None), ("y", 1, []), ("z", 2, ["q"] * 50)],
        schema,
    )
    vocab = spark.createDataFrame([(0, "UNK", 0), (1, "a", 2), (2, "b", 1)], "id bigint, token string, cnt bigint")
    wanted = {("x", 0): [1, 2, 0, 1, 2], (None, None): [1, 0], ("y", None): [], ("y", 1): [], ("z", 2): [0] * 50}
    for bound in (0, 1 << 20):
        coded = op.encode(rows, vocab, ["k", "n"], broadcast_bytes=bound)
        assert {(r["k"], r["n"]): r["ids"] for r in coded.collect()} == wanted
        back = op.decode(coded, vocab, ["k", "n"], broadcast_bytes=bound)
        names = {0: "UNK", 1: "a", 2: "b"}
        assert {(r["k"], r["n"]): r["tokens"] for r in back.collect()} == {k: [names[i] for i in v] for k, v in wanted.items()}


def test_encode_does_not_shuffle_running_tokens(spark):
    rows = spark.range(200).select("id", F.expr("transform(sequence(1, 500), i -> concat('w', i % 7))").alias("tokens"))
    vocab = op.build_vocab(rows.select(F.explode("tokens").alias("token")))
    sizes = op.encode(rows, vocab, ["id"], broadcast_bytes=0)
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    # 100,000 running tokens; their places are never rows.
    assert "posexplode" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert sizes.agg(F.sum(F.size("ids"))).first()[0] == 100_000


def test_decode_outside_the_table(spark):
    vocab = op.build_vocab(tokens_of(spark, ["a"]))
    rows = spark.createDataFrame([(0, [4, 99, -1])], "line_no bigint, ids array<bigint>")
    assert op.decode(rows, vocab, ["line_no"]).first()["tokens"] == ["a", "UNK", "UNK"]


def test_given_list_and_added_tokens(spark):
    given = spark.createDataFrame([("q", 1), ("p", 0)], "token string, at bigint")
    more = spark.createDataFrame([("p", 0), ("r", 2), ("s", 1), ("r", 5)], "token string, at bigint")
    base = op.set_vocab(given, "at", specials=[])
    assert listing(base) == ["p", "q"]
    assert listing(op.add_tokens(base, more, "at")) == ["p", "q", "s", "r"]
    assert listing(op.set_vocab(given, "at"))[:4] == op.SPECIALS


def test_membership_and_oov(spark):
    vocab = op.build_vocab(tokens_of(spark, ["a b"]))
    tokens = tokens_of(spark, ["a c a d"])
    assert sorted(r["token"] for r in op.contains(tokens, vocab).collect()) == ["a", "a"]
    row = op.oov_rate(op.token_counts(tokens), vocab).first()
    assert (row["n_tokens"], row["n_oov"], row["n_types"], row["n_oov_types"], row["oov_rate"]) == (4, 2, 3, 2, 0.5)


def test_threshold(spark):
    counts = op.token_counts(tokens_of(spark, ["a " * 9 + "a", "b"]))
    assert [r["token"] for r in op.frequent(counts, 10).collect()] == ["a"]


def test_codes_of_a_chunk_travel_as_bytes():
    # As integers of four bytes the codes were most of what a row brings to its chunk.
    rows = [[0, 127, 128], [], [16_383, 16_384, 2**21 - 1, 2**21], [2**28 - 1, 2**28, 2**31 - 1], []]
    ends = np.cumsum([0, *map(len, rows)])
    numbers = np.array([n for row in rows for n in row])
    packed = op._packed(numbers, ends)
    assert [len(row) for row in packed.to_pylist()] == [4, 0, 12, 14, 0]
    for some in (packed, packed.slice(2, 2)):
        found, at = op._unpacked(some)
        whole = rows if some is packed else rows[2:4]
        assert [found[a:b].tolist() for a, b in zip(at, at[1:])] == whole
    found, at = op._unpacked(op._packed(numbers[:0], ends[:1]))
    assert len(found) == 0 and at.tolist() == [0]
