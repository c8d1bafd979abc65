"""BLEU, self-BLEU and reports."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.operators import bleu as op
from weft.operators import jobs, vocabulary

TRIPLE = ["the cat sat on the mat", "the cat sat on a mat", "a cat is on the mat"]


def sentence_bleu(spark, hyp, ref):
    df = spark.createDataFrame([(0, hyp.split(), ref.split())], "k bigint, hyp array<string>, ref array<string>")
    return op.bleu_stats(df, ["k"]).select(op.smoothed_bleu().alias("b")).first()["b"]


def triple_lines(spark, *triples):
    rows = [(b * 3 + i, t) for b, triple in enumerate(triples) for i, t in enumerate(triple)]
    return spark.createDataFrame(rows, "line_no bigint, text string")


@pytest.mark.parametrize(
    "hyp, ref, score",
    [
        ("a b c d", "a b c e", 66.874030),
        ("a b", "a b c", 60.653066),
        ("", "a", 0.0),
        ("a a a", "a b", 53.728497),
        ("", "", 0.0),
    ],
)
def test_smoothed(spark, hyp, ref, score):
    assert sentence_bleu(spark, hyp, ref) == pytest.approx(score, abs=1e-6)


def test_stats(spark):
    df = spark.createDataFrame([(0, "a b a".split(), "a a b".split())], "k bigint, hyp array<string>, ref array<string>")
    row = op.bleu_stats(df, ["k"]).first().asDict()
    assert [row[f"match{n}"] for n in op.ORDERS] == [3, 1, 0, 0]
    assert [row[f"total{n}"] for n in op.ORDERS] == [3, 2, 1, 0]


def test_mean_sentence_bleu(spark):
    rows = [
        (0, "<s> a b c d x y </s>".split(), "<s> a b c e </s>".split()),  # cut to four tokens
        (1, "<s> </s>".split(), "<s> a </s>".split()),
    ]
    df = spark.createDataFrame(rows, "k bigint, hyp array<string>, ref array<string>")
    row = op.mean_sentence_bleu(df, ["k"]).first()
    assert row["n_pairs"] == 2 and row["mean_bleu"] == pytest.approx(66.874030 / 2, abs=1e-6)


def test_self_bleu_golden(spark):
    blocks = op.triples(triple_lines(spark, TRIPLE))
    scores = op.self_bleu(blocks)
    row = scores.first()
    assert [row[f"bleu{i}"] for i in op.SIDES] == pytest.approx([67.560008, 56.234133, 34.329452], abs=1e-6)
    report = op.diversity_report(scores).first()
    assert (report["n_triples"], report["mean_bleu"], report["mean_std"]) == (1, 52.71, 13.79)


def test_self_bleu_edges(spark):
    same, short, empty = ["a b c d"] * 3, ["a b c"] * 3, [""] * 3
    rows = {r["block"]: r for r in op.self_bleu(op.triples(triple_lines(spark, same, short, empty))).collect()}
    assert [rows[0][f"bleu{i}"] for i in op.SIDES] == pytest.approx([100.0] * 3)
    assert [rows[1][f"bleu{i}"] for i in op.SIDES] == [0.0] * 3
    assert [rows[2][f"bleu{i}"] for i in op.SIDES] == [0.0] * 3


def test_incomplete_block_is_left_out(spark):
    lines = triple_lines(spark, TRIPLE, TRIPLE[:2])
    assert [r["block"] for r in op.self_bleu(op.triples(lines)).collect()] == [0]


def test_sample_is_repeatable_and_checked(spark):
    blocks = spark.range(40).select(F.col("id").alias("block"))
    first = sorted(r["block"] for r in op.sample_blocks(blocks, 10).collect())
    again = sorted(r["block"] for r in op.sample_blocks(blocks.repartition(7), 10).collect())
    assert first == again and len(set(first)) == 10
    assert sorted(r["line_no"] for r in op.sample_lines(op.sample_blocks(blocks, 1)).collect()) == [
        3 * op.sample_blocks(blocks, 1).first()["block"] + i for i in range(3)
    ]
    with pytest.raises(Exception, match="fewer than 41"):
        op.sample_blocks(blocks, 41).collect()


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_tags_by_lexicon_and_by_function(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", broadcast_bytes)
    lines = spark.createDataFrame([(0, "the cat sat"), (1, "")], "k bigint, text string")
    lexicon = spark.createDataFrame([("the", "D"), ("cat", "N")], "token string, class string")
    found = {r["k"]: r["text"] for r in op.tag_sequences(lines, ["k"], lexicon).collect()}
    assert found == {0: "D N X", 1: ""}

    @F.pandas_udf("string")
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(str(len(w)) for w in t.split()))

    assert op.tag_sequences(lines, ["k"], None, tagger=lengths).orderBy("k").first()["text"] == "3 3 3"


def test_diversity_job(spark, tmp_path):
    lexicon = spark.createDataFrame([("the", "D", 0)], "token string, class string, rank bigint")
    lines = triple_lines(spark, TRIPLE, TRIPLE, ["a b c d"] * 3)
    result = jobs.diversity(lines, 3, lexicon, out=str(tmp_path / "m"))
    report = {r["kind"]: r["mean_bleu"] for r in result.report.collect()}
    assert report["words"] == pytest.approx((52.707864 * 2 + 100) / 3, abs=0.01)
    assert spark.read.parquet(str(tmp_path / "m" / "bleus")).count() == 3
    assert spark.read.parquet(str(tmp_path / "m" / "lines")).count() == 9
    assert spark.read.parquet(str(tmp_path / "m" / "pos_bleus")).count() == 3


def test_grams_are_no_rows(spark):
    # A row for each n-gram made the groupings of one task grow with its text.
    pairs = spark.createDataFrame([(1, ["a"], ["a"])], "k bigint, hyp array<string>, ref array<string>")
    lines = triple_lines(spark, TRIPLE)
    for df in (op.bleu_stats(pairs, ["k"]), op.self_bleu(op.triples(lines))):
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_repeated_keys_missing_tokens_and_repeated_grams(spark):
    rows = [(1, "a b a b a".split(), "a b a c".split()), (1, ["c"], ["c"]), (2, None, ["x"]), (None, ["y"], ["y"]), (3, [], [])]
    df = spark.createDataFrame(rows, "k bigint, hyp array<string>, ref array<string>").coalesce(1)
    found = {r["k"]: tuple(r)[1:] for r in op.bleu_stats(df, ["k"]).collect()}
    assert found == {
        # Both pairs of key 1 count together: 4 of 6 words, a b and b a once each, a b a once.
        1: (6, 5, 4, 6, 2, 5, 1, 4, 0, 3),
        2: (0, 1, 0, 0, 0, 0, 0, 0, 0, 0),
        None: (1, 1, 1, 1, 0, 0, 0, 0, 0, 0),
        3: (0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    }


def test_tags_of_a_large_lexicon_are_no_rows(spark, monkeypatch):
    # A row for each token went to its lexicon entry and back to its line, many times the text.
    rows = [(0, "the cat sat"), (0, "on the"), (1, ""), (2, None), (None, "cat the"), (None, "x"), (3, " the  odd ")]
    lines = spark.createDataFrame(rows, "k bigint, text string")
    lexicon = spark.createDataFrame([("the", "D"), ("cat", "N"), ("odd", None)], "token string, class string")
    found = []
    for broadcast_bytes in (1 << 20, 0):
        monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", broadcast_bytes)
        tagged = op.tag_sequences(lines, ["k"], lexicon)
        found.append(sorted(map(str, tagged.collect())))
    assert found[0] == found[1] and len(found[0]) == 5
    assert "Generate" not in tagged._jdf.queryExecution().executedPlan().toString()
