"""The quality classifier: held-out accuracy, plain densities, odd rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F
from weft.llm import discriminant, queries

SF_DIR = "/root/testdata/sf0.01"
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


def test_held_out_labels(spark):
    found = {r.doc_id: r for r in queries.op13_discriminant(spark, SF_DIR).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(found[i].predicted, q) for i, q in labels.items() if found[i].held_out]
    for value in (0, 1):
        group = [p for p, q in held if q == value]
        assert sum(p == value for p in group) >= 0.95 * len(group)


def test_scores_do_not_read_labels_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.expr(HELD_OUT), 1 - F.col("quality")).otherwise(F.col("quality")))
    bare = docs.select("doc_id", "text")
    one = discriminant.assess(docs, labels, F.expr(HELD_OUT)).collect()
    two = discriminant.assess(bare, flipped, F.expr(HELD_OUT)).collect()
    assert np.allclose([r.score for r in sorted(one)], [r.score for r in sorted(two)], atol=1e-6)


def test_statistics_of_a_text():
    s = dict(zip(discriminant.STATISTICS, discriminant.statistics("Ab ab! ## 12\n\nab! é.".encode())))

    def angle(x):
        return math.asin(math.sqrt(x))

    assert s["words"] == math.log1p(6)
    assert math.isclose(s["word_length"], math.log(14 / 6))
    assert math.isclose(s["distinct_words"], angle(5 / 6)) and math.isclose(s["top_word"], angle(2 / 6))
    assert math.isclose(s["line_words"], math.log(3)) and s["repeated_lines"] == 0
    assert math.isclose(s["upper"], angle(1 / 6)) and math.isclose(s["ended_words"], angle(4 / 6))
    assert math.isclose(s["symbols"], angle(2 / 15)) and math.isclose(s["digits"], angle(2 / 15))
    assert discriminant.statistics(None) == discriminant.statistics(b"") == [0.0] * len(s)
    assert discriminant.statistics(b" \n")[1:] == [0.0] * (len(s) - 1)


def test_margins_equal_plain_densities():
    rng = np.random.default_rng(5)
    p = len(discriminant.STATISTICS)
    rows = [rng.normal(k, 1 + k, (400 - 100 * k, p)) for k in range(2)]
    moments = np.array([np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())) for x in rows])
    model = discriminant.Discriminant(moments, 0.3, 0.1)
    every = np.concatenate(rows)
    z = [(x - every.mean(0)) / every.std(0) for x in rows]
    within = sum(len(x) * np.cov(x.T, bias=True) for x in z) / len(every)
    probe = (every[:20] - every.mean(0)) / every.std(0)
    sides = []
    for x in z:
        mixed = 0.7 * np.cov(x.T, bias=True) + 0.3 * within
        mixed = 0.9 * mixed + 0.1 * np.trace(mixed) / p * np.eye(p)
        d = probe - x.mean(0)
        far = np.einsum("ij,jk,ik->i", d, np.linalg.inv(mixed), d)
        sides.append(math.log(len(x) / len(every)) - 0.5 * (far + np.linalg.slogdet(mixed)[1]))
    assert np.allclose(model.margins(every[:20]), sides[1] - sides[0])


def test_odd_rows(spark, docs, texts, no_docs):
    labels = spark.createDataFrame(
        [(i, i % 2, None) for i in range(5, 40)] + [(1, 1, 1), (1, 0, 0), (2, None, 0), (3, 7, 1), (None, 1, 0), (50, 1, 0), (50, 1, 0), (999, 0, 0)],
        "doc_id long, quality int, text string",
    )
    found = discriminant.assess(docs, labels, F.expr(HELD_OUT)).collect()
    assert len(found) == len(texts)
    scores = {}
    for r in found:
        assert 0 <= r.score <= 1 and r.held_out is not None
        assert r.doc_id is not None or not r.held_out
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert len(scores[50]) == 1
    assert scores[0] == scores[1] and scores[43] == scores[44]  # null and empty; equal texts
    assert discriminant.assess(no_docs, labels, F.expr(HELD_OUT)).collect() == []
    assert {r.score for r in discriminant.assess(docs, labels.limit(0), F.expr(HELD_OUT)).collect()} == {0.5}
    ones = discriminant.assess(docs, labels.filter("quality = 1"), F.expr(HELD_OUT)).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.5


def test_a_very_long_text(spark):
    text = "word " * 2_000_000
    docs = spark.createDataFrame([(1, text), (2, "x" * 10_000_000), (3, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert discriminant.assess(docs, labels, F.lit(False)).count() == 3
