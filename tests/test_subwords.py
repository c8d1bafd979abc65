"""Byte-pair encoding against one merge at a time, and casing."""

import random
from collections import Counter

import pytest

from weft.operators import casing, jobs, subwords, vocabulary


def learn_plainly(words, merges, min_count=2):
    table = [([*w[:-1], w[-1] + "</w>"], n) for w, n in words.items()]
    learnt = []
    for _ in range(merges):
        pairs = Counter()
        for symbols, n in table:
            for pair in zip(symbols, symbols[1:]):
                pairs[pair] += n
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        if pairs[best] < min_count:
            break
        learnt.append((*best, pairs[best]))
        table = [(join(symbols, best), n) for symbols, n in table]
    return learnt


def join(symbols, pair):
    out, i = [], 0
    while i < len(symbols):
        hit = tuple(symbols[i : i + 2]) == pair
        out.append(symbols[i] + symbols[i + 1] if hit else symbols[i])
        i += 2 if hit else 1
    return out


def words(seed, alphabet, n=120):
    rng = random.Random(seed)
    return {
        "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))): rng.randint(1, 50) for _ in range(n)
    }


def types(spark, found):
    return spark.createDataFrame(list(found.items()), "token string, cnt bigint")


@pytest.mark.parametrize("seed, alphabet", [(1, "abc"), (2, "aab"), (3, "abcdefgh.$\\")])
def test_learning_in_rounds_equals_one_by_one(spark, seed, alphabet):
    found = words(seed, alphabet)
    learnt = subwords.learn_bpe(types(spark, found), 60).orderBy("rank").collect()
    assert [(r["left"], r["right"], r["cnt"]) for r in learnt] == learn_plainly(found, 60)


@pytest.mark.parametrize("pairs, cuts, merges", [(6, 200_000, 10), (20_000, 12, 6), (2, 3, 4)])
def test_rounds_of_few_pairs_and_few_cuts(spark, pairs, cuts, merges):
    found = words(2, "aab", n=60)
    learnt = subwords.learn_bpe(types(spark, found), merges, pairs=pairs, cuts=cuts).orderBy("rank").collect()
    assert [(r["left"], r["right"], r["cnt"]) for r in learnt] == learn_plainly(found, merges)


def test_learning_until_pairs_run_out(spark):
    found = words(5, "abcdé<", n=25) | {"a</w>a</w>": 7, "<//w>": 3}
    learnt = subwords.learn_bpe(types(spark, found)).orderBy("rank").collect()
    assert [(r["left"], r["right"], r["cnt"]) for r in learnt] == learn_plainly(found, 16_000)
    assert subwords.learn_bpe(types(spark, {"a": 5})).collect() == []


def test_playing_merges_on_cuts():
    rng = random.Random(9)
    cuts = {"".join(rng.choice("aab") for _ in range(rng.randint(2, 9))): rng.randint(1, 9) for _ in range(40)}
    played = subwords._Cuts([(list(c), n) for c, n in cuts.items()])
    table = [(list(c), n) for c, n in cuts.items()]
    for _ in range(12):
        pairs = Counter()
        for symbols, n in table:
            for pair in zip(symbols, symbols[1:]):
                pairs[pair] += n
        best = max(pairs, key=lambda p: (pairs[p], p))
        assert played.best() == (best, pairs[best])
        played.merge(best)
        table = [(join(symbols, best), n) for symbols, n in table]


def test_segments_equal_merges_in_order(spark):
    found = words(4, "abcd")
    merges = subwords.learn_bpe(types(spark, found), 20)
    plain = learn_plainly(found, 20)
    for row in subwords.segment_types(types(spark, found), merges).collect():
        symbols = [*row["token"][:-1], row["token"][-1] + "</w>"]
        for left, right, _ in plain:
            symbols = join(symbols, (left, right))
        assert row["pieces"] == [s[:-4] if s.endswith("</w>") else s + "@@" for s in symbols]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_apply_with_threshold(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", broadcast_bytes)
    merges = spark.createDataFrame([(0, "a", "b"), (1, "ab", "c</w>"), (2, "x", "y</w>")], "rank bigint, left string, right string")
    rows = spark.createDataFrame([(0, ["abc", "xy", "q"]), (1, []), (2, ["abd"])], "line_no bigint, tokens array<string>")
    plain = {r["line_no"]: r["tokens"] for r in subwords.apply_bpe(rows, merges, ["line_no"]).collect()}
    assert plain == {0: ["abc", "xy", "q"], 1: [], 2: ["ab@@", "d"]}
    pieces = spark.createDataFrame([("abc", 9), ("ab@@", 12), ("xy", 10)], "piece string, cnt bigint")
    split = {r["line_no"]: r["tokens"] for r in subwords.apply_bpe(rows, merges, ["line_no"], pieces=pieces).collect()}
    assert split == {0: ["ab@@", "c", "xy", "q"], 1: [], 2: ["ab@@", "d"]}


def test_apply_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(0, ["abc", "xy", "q"]), (1, []), (2, ["abd", None, "abc"]), (3, None), (2, ["xy"])], "line_no bigint, tokens array<string>"
    )
    merges = spark.createDataFrame(
        [(0, "a", "b", 3), (1, "ab", "c</w>", 2), (2, "x", "y</w>", 1)], "rank bigint, left string, right string, cnt bigint"
    )
    wanted = {0: ["abc", "xy", "q"], 1: [], 2: ["ab@@", "d", "xy", "abc"], 3: []}
    for bound, step in ((1 << 20, "BroadcastHashJoin"), (0, "FlatMapCoGroupsInArrow")):
        monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", bound)
        coded = subwords.apply_bpe(rows, merges, ["line_no"])
        assert {r["line_no"]: r["tokens"] for r in coded.collect()} == wanted
        assert step in coded._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_casing(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", broadcast_bytes)
    rows = [(0, "The US saw the us and The US".split()), (1, ["the"]), (2, ["US"]), (3, ["New", "B", "b"]), (4, [])]
    df = spark.createDataFrame(rows, "line_no bigint, tokens array<string>")
    model = casing.truecase_model(df)
    assert {r["lower"]: (r["token"], r["cnt"]) for r in model.collect()} == {
        "us": ("US", 2), "saw": ("saw", 1), "the": ("The", 1), "and": ("and", 1), "b": ("B", 1),
    }
    cased = {r["line_no"]: r["tokens"] for r in casing.truecase(df, model).collect()}
    assert cased[1] == ["The"] and cased[2] == ["US"] and cased[3] == ["New", "B", "b"] and cased[4] == []


def test_prepare_pairs(spark):
    rows = [(i, "A “cat” sat.", "un chat " * (1 + i % 3)) for i in range(30)] + [(99, "", "x")]
    pairs = spark.createDataFrame(rows, "line_no bigint, src string, tgt string")
    result = jobs.prepare_pairs(pairs, ["line_no"], "en", "fr", merges=10)
    assert result.pairs.count() == 30
    assert result.vocab.orderBy("id").first()["token"] == "</s>"
    src = result.pairs.filter("line_no = 0").first()["src"]
    assert src.replace("@@ ", "") == 'A " cat " sat .'
