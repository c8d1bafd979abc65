"""Metric tables, pooling, projection and skewed joins."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import metrics, projection, skew


@pytest.mark.parametrize("maximise", [False, True])
def test_best_so_far_of_a_hot_run(spark, maximise):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"r{i % 7}", i, float(rng.randint(0, 10_000)) - (5e4 if maximise and i < 9 else 0)) for i in range(6000)]
    df = spark.createDataFrame(rows, "run string, step bigint, value double")
    found = {(r["run"], r["step"]): (r["best_before"], r["improved"]) for r in metrics.best_so_far(df, ["run"], ["step"], maximise=maximise).collect()}
    pick, start = (max, metrics.WORST_HIGH) if maximise else (min, metrics.WORST_LOW)
    best = {}
    for run, step, value in rows:
        before = best.get(run, start)
        assert found[run, step] == (before, pick(value, before) == value)
        best[run] = pick(value, before)
    assert len(found) == len(rows)


def test_means_and_mix(spark):
    rows = [("a", 1, "bleu", 10.0), ("a", 1, "bleu", 20.0), ("a", 1, "loss", 0.5), ("a", 2, "loss", 1.0)]
    log = spark.createDataFrame(rows, "run string, epoch bigint, name string, value double")
    found = {(r["epoch"], r["name"]): r["value"] for r in metrics.with_mix(metrics.epoch_means(log), "bleu", "loss").collect()}
    assert found == {(1, "bleu"): -15.0, (1, "loss"): 0.5, (1, "mix"): -15.0 + 0.5 / 0.02, (2, "loss"): 1.0}


def test_label_eval(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([3.0, 0.0], 1)], "scores array<double>, label int")
    row = metrics.label_eval(df).first()
    nll = [math.log(math.exp(1) + math.exp(2)) - 2, math.log(math.exp(3) + 1) - 0]
    assert row["accuracy"] == 0.5 and row["mean_nll"] == pytest.approx(sum(nll) / 2)


def test_fingerprints(spark):
    lines = [f"line {i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(lines)), "idx bigint, text string")
    digest = hashlib.sha1("\n".join(lines).encode()).hexdigest()[-8:]
    assert metrics.ordered_fingerprint(df.repartition(4), "idx", "text").first()["fingerprint"] == digest
    with pytest.raises(Exception, match="at most 10 rows"):
        metrics.ordered_fingerprint(df, "idx", "text", rows=10).collect()
    one, two = (metrics.set_fingerprint(d, "text").first() for d in (df, df.repartition(3)))
    assert one == two and one["n"] == 20
    pairs = [[("a", None), ("a", None)], [], [("a", "")] * 2, [(None, "a")] * 2, [("a", None)]]
    frames = [spark.createDataFrame(rows, "x string, y string") for rows in pairs]
    assert len({metrics.set_fingerprint(d, "x", "y").first() for d in frames}) == 5


def test_pool_and_project(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], True), ("a", [3.0, 4.0], True), ("a", [9.0, 9.0], False)], "k string, vec array<double>, mask boolean")
    pooled = projection.mean_pool(df, ["k"], mask="mask").first()["pooled"]
    assert pooled == pytest.approx([2.0, 3.0], abs=1e-6)
    weights = spark.createDataFrame([(1, [1.0, 0.0], 0.5), (0, [0.0, -1.0], 0.0)], "bit int, weights array<double>, bias double")
    assert projection.project(df, weights).first()["scores"] == [-2.0, 1.5]
    many = spark.range(70).selectExpr("int(id) as bit", "array(1d, 1d) as weights", "0d as bias")
    with pytest.raises(Exception, match="more than 62"):
        projection.project(df, many).collect()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_skewed_join_equals_plain_join(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "HOT_SHARE", 50)
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 1500}")) for i in range(9000)]
    left = spark.createDataFrame(rows, "id bigint, key string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 1500, 2)], "key string, v bigint")
    ours = sorted(map(str, skew.join_unique(left, right, "key", ["id"], how).collect()))
    assert ours == sorted(map(str, left.join(right, "key", how).collect()))
    hot = spark.range(1).select(F.xxhash64(F.lit("hot")).alias("h")).first()["h"]
    groups = {r["__hash"]: r["__groups"] for r in skew.hot_keys(left, "key").collect()}
    keys = [key for _, key in rows if key is not None]
    assert groups[hot] == -(-keys.count("hot") * skew.HOT_SHARE // len(keys))
    assert sum(groups.values()) < 2 * skew.HOT_SHARE
