"""Numbering, shards, batches and splits."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weft import plans
from weft.functions import text
from weft.operators import alignment, jobs, ordering
from weft.functions.permutation import permuted
from weft.operators import batching as op
from weft.operators import budget as budgets
from weft.session import freeze
from weft.sources import tables


def lengths(spark, values):
    return spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], "line_no bigint, n_src int, n_tgt int")


def greedy(values, budget):
    batches = [[]]
    for v in values:
        if max([*batches[-1], v]) * (len(batches[-1]) + 1) > budget:
            batches.append([])
        batches[-1].append(v)
    return [i for i, batch in enumerate(batches) for _ in batch]


def test_keys_out_of_range_are_errors(spark):
    for key in (-5, 1 << 60, None):
        df = spark.createDataFrame([(3,), (key,)], "id bigint")
        with pytest.raises(Exception, match="outside 0 to"):
            op.dense_index(df, "id").collect()


@pytest.mark.parametrize("values, expected", [([3, 4, 2, 5], [0, 0, 1, 2]), ([9, 1], [1, 2])])
def test_token_budget_golden(spark, values, expected):
    found = op.token_batches(lengths(spark, values), 8).orderBy("line_no").collect()
    assert [r["batch_no"] for r in found] == expected == greedy(values, 8)


@pytest.mark.parametrize("n, budget, slice_rows, longest", [(1, 8, 1, 9), (500, 40, 50, 12), (300, 12, 3, 20), (2000, 40, 1, 12), (700, 30, 37, 60)])
@pytest.mark.parametrize("fan", [2, 64])
def test_token_budget_over_any_slices(spark, monkeypatch, n, budget, slice_rows, longest, fan):
    """Slices shorter and longer than a batch, rows above the budget, trees of several levels."""
    monkeypatch.setattr(budgets, "FAN_BYTES", fan * 16 * budget)
    rng = random.Random(n)
    values = [rng.randint(1, longest) for _ in range(n)]
    found = op.token_batches(lengths(spark, values).repartition(5), budget, slice_rows=slice_rows).orderBy("line_no").collect()
    assert [r["batch_no"] for r in found] == greedy(values, budget)


def test_token_budget_of_odd_inputs(spark):
    assert op.token_batches(lengths(spark, [1]).filter("line_no > 0"), 8).collect() == []
    with pytest.raises(Exception, match="consecutive"):
        op.token_batches(lengths(spark, [3, 3, 3]).filter("line_no <> 1"), 8).collect()
    with pytest.raises(Exception, match="no tokens"):
        op.token_batches(lengths(spark, [3]).withColumns({"n_src": F.lit(0), "n_tgt": F.lit(0)}), 8).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1600, 5000])
def test_permutation_and_its_inverse(spark, n):
    df = spark.range(n).select(F.col("id").alias("i"))
    there = permuted(df, "i", n, "a:1", "p")
    rows = permuted(there, "p", F.lit(n), "a:1", "back", inverse=True).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["back"] == r["i"] for r in rows)
    if n >= 10:
        other = {r["i"]: r["p"] for r in permuted(df, "i", n, "a:2", "p").collect()}
        assert other != {r["i"]: r["p"] for r in rows} != {i: i for i in range(n)}
    with pytest.raises(Exception, match="not below"):
        permuted(df, "i", n - 1, 1, "p").collect()


def test_batches_are_shuffled_and_restored(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(20)], "line_no bigint, batch_no bigint")
    placed = op.shuffle_batches(df, seed=5)
    pairs = {(r["batch_no"], r["place"]) for r in placed.collect()}
    assert sorted(b for b, _ in pairs) == sorted(p for _, p in pairs) == list(range(7))
    assert all(r["batch_no"] == r["back"] for r in op.restore_batches(placed, seed=5, out="back").collect())


def test_parts_leave_the_remainder_out(spark):
    df = ordering.split_file_parts(spark.range(10).select(F.col("id").alias("line_no")), 3, 10)
    parts = [r["part"] for r in df.orderBy("line_no").collect()]
    assert parts == [0, 0, 0, 1, 1, 1, 2, 2, 2, None]


def test_shards(spark):
    df = spark.createDataFrame([(29_999,), (30_000,), (0,)], "line_no bigint")
    assert {r["line_no"]: r["shard_id"] for r in op.shard(df).collect()} == {0: 0, 29_999: 0, 30_000: 1}
    back = op.combine_shards(op.shard(df)).select("line_no")
    assert sorted(r["line_no"] for r in back.collect()) == [0, 29_999, 30_000]


@pytest.mark.parametrize("n, kept", [(0, 0), (1, 1), (58, 1), (59, 0)])
def test_pair_length(spark, n, kept):
    df = spark.createDataFrame([(["a"] * n, ["b"])], "src array<string>, tgt array<string>")
    wrapped = df.select(text.wrap("src").alias("src"), text.wrap("tgt").alias("tgt"))
    assert alignment.length_filter(wrapped, "src", "tgt").count() == kept


def test_sharded_map(spark):
    rows = [(i, "x" * (i * 7 % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "line_no bigint, line string")
    seen = op.sharded_map(df, lambda lines: [str(len(line)) for line in lines], lines=64)
    assert {r["line_no"]: r["output"] for r in seen.collect()} == {i: str(len(t)) for i, t in rows}
    with pytest.raises(Exception, match="outputs for"):
        op.sharded_map(df, lambda lines: lines[1:]).collect()


IDS = [0, 5, 1 << 19, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 3 << 30, 1 << 41, (1 << 59) + 7]


def test_dense_index_over_sparse_ids(spark):
    df = spark.createDataFrame([(i, str(i)) for i in random.Random(1).sample(IDS, len(IDS))], "id bigint, t string")
    found = ordering.dense_index(df, "id", "n").orderBy("id").collect()
    assert [(r["id"], r["n"]) for r in found] == [(i, n) for n, i in enumerate(IDS)]


def test_ranked_with_ties_on_the_first_column(spark):
    rows = [(1, f"t{i:04d}") for i in range(2000)] + [(2, "a"), (0, "z")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "cnt bigint, token string")
    found = ordering.ranked(df, [F.col("cnt").desc(), F.col("token")]).orderBy("idx").collect()
    assert [(r["cnt"], r["token"]) for r in found] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [r["idx"] for r in found] == list(range(len(rows)))


def test_hashed_index_is_a_permutation(spark):
    df = spark.range(500).select(F.col("id").alias("k"))
    first = {r["k"]: r["idx"] for r in ordering.hashed_index(df, ["k"], 3).collect()}
    again = {r["k"]: r["idx"] for r in ordering.hashed_index(df.repartition(5), ["k"], 3).collect()}
    other = {r["k"]: r["idx"] for r in ordering.hashed_index(df, ["k"], 4).collect()}
    assert sorted(first.values()) == list(range(500))
    assert first == again != other


def test_split_rounds_training_only(spark):
    df = spark.range(1150).select(F.col("id").alias("k"))
    rows = op.train_valid_split(df, ["k"], batch_size=64).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"valid": 1000, "train": 128}
    small = op.train_valid_split(df.filter("k < 10"), ["k"], batch_size=64)
    assert [r["count"] for r in small.groupBy("split").count().collect()] == [10]


def test_fixed_batches(spark):
    df = spark.range(10).select(F.col("id").alias("idx"))
    assert op.fixed_batches(df, 4).count() == 10
    kept = op.fixed_batches(df, 4, drop_last=True).orderBy("idx").collect()
    assert [(r["batch_id"], r["pos_in_batch"]) for r in kept] == [(i // 4, i % 4) for i in range(8)]


def test_bootstrap_fills_up(spark):
    every = spark.range(50).select(F.col("id").alias("line_no"))
    survivors = every.filter("line_no % 5 = 1").withColumn("x", F.col("line_no") * 2)
    found = op.bootstrap_pad(survivors, every).collect()
    assert sorted(r["stands_for"] for r in found) == list(range(50))
    assert all(r["line_no"] % 5 == 1 and r["x"] == 2 * r["line_no"] for r in found)
    assert all(r["line_no"] == r["stands_for"] for r in found if r["stands_for"] % 5 == 1)


def test_padding_and_order(spark):
    df = spark.createDataFrame([(0, 0, [7, 8]), (0, 1, [9]), (1, 2, [])], "batch_id bigint, line_no bigint, ids array<bigint>")
    assert [r["ids"] for r in op.pad_batch(df).orderBy("line_no").collect()] == [[7, 8], [9, 0], []]
    placed = op.order_in_batch(df.withColumn("n", F.size("ids")), "n")
    assert [r["place"] for r in placed.orderBy("line_no").collect()] == [1, 0, 0]


def test_alignment(spark):
    left = spark.createDataFrame([(i, f"s{i}") for i in range(3)], "line_no bigint, src string")
    right = spark.createDataFrame([(i, f"t{i}") for i in range(2)], "line_no bigint, tgt string")
    assert alignment.zip_lines(left, right).count() == 2
    assert alignment.strict_zip(left.filter("line_no < 2"), right).count() == 2
    with pytest.raises(Exception, match="without counterpart: 2"):
        alignment.strict_zip(left, right).collect()
    assert [(r["line_no"], r["side"]) for r in alignment.unmatched(left, right).collect()] == [(2, "left")]
    tripled = alignment.replicate(right).orderBy("out_no").collect()
    assert [(r["out_no"], r["tgt"]) for r in tripled] == [(i, f"t{i // 3}") for i in range(6)]
    woven = alignment.interleave([left, left.withColumn("src", F.upper("src"))]).orderBy("out_no").collect()
    assert [r["src"] for r in woven] == ["s0", "S0", "s1", "S1", "s2", "S2"]
    assert alignment.first_lines(left, 2).count() == 2 and alignment.first_lines(left, 0).count() == 3
    assert [r["line_no"] for r in alignment.truncate(left.filter("line_no > 0"), 1).collect()] == [1]


def merge(spark, corpus, export, **options):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(corpus)], "line_no bigint, src string, cfg string, tgt string")
    lines = spark.createDataFrame(list(enumerate(export)), "line_no bigint, value string")
    merged = alignment.merge_codes(rows, lines, ["line_no"], **options).orderBy("line_no").collect()
    return [(r["line"], r["status"]) for r in merged]


def test_code_merge(spark):
    export = ["a\tT\t1", "b\tT\t7 0", "a\tT\t2", "\tT\t5", "x\ty\tT\t3"]
    corpus = [(" a ", "T", "ta "), ("b", "T", "tb"), ("c", "T", "tc"), ("", "T", "td"), ("x\ty", "T", "te")]
    assert merge(spark, corpus, export) == [
        ("<c3> <eoc> ta", "merged"),  # the last export line of a pair wins
        ("<c8> <c1> <eoc> tb", "merged"),
        ("<ERR>tc", "missing"),
        ("<ERR>td", "missing"),  # an export line without a source has two fields only
        ("<c4> <eoc> te", "merged"),
    ]
    assert merge(spark, corpus[2:3], export, err_mode="reference") == [("<ERR>x\ty\tT\t3", "missing")]


def test_training_data(spark):
    rows = [(i, "a " * (i % 70), "b " * (1 + i % 9)) for i in range(400)]
    pairs = spark.createDataFrame(rows, "line_no bigint, src string, tgt string")
    kept = [r for r in rows if 1 <= r[0] % 70 <= 58]
    found = jobs.training_data(pairs, n_valid=50, batch_size=16).collect()
    train = [r for r in found if r["split"] == "train"]
    assert len(found) - len(train) == 50 and len(train) == (len(kept) - 50) // 16 * 16
    tokens = jobs.training_data(pairs, n_valid=50, batch_size=500, batch_type="token", truncate=300).collect()
    assert len(tokens) == 300
    sizes = {}
    for r in tokens:
        key = (r["split"], r["batch_id"])
        n, longest = sizes.get(key, (0, 0))
        sizes[key] = (n + 1, max(longest, len(r["src"]), len(r["tgt"])))
    assert all(n * longest <= 500 for n, longest in sizes.values())
    for split in ("valid", "train"):
        places = {(r["batch_id"], r["batch_place"]) for r in tokens if r["split"] == split}
        assert sorted(b for b, _ in places) == sorted(p for _, p in places) == list(range(len(places)))


def test_training_data_with_own_callables(spark):
    rows = [(i, "b" * (1 + i % 5), "t") for i in range(20)]
    pairs = spark.createDataFrame(rows, "line_no bigint, src string, tgt string")
    found = jobs.training_data(
        pairs,
        n_valid=0,
        batch_size=5,
        preprocess=text.split_chars,
        keep=lambda src, tgt: F.size(src) >= 2,
        sort_key=lambda src, tgt: -F.size(src),
    ).collect()
    assert len(found) == 15
    for batch in range(3):
        rows = sorted((r for r in found if r["batch_id"] == batch), key=lambda r: r["place"])
        sizes = [len(r["src"]) for r in rows]
        assert sizes == sorted(sizes, reverse=True) and min(sizes) >= 2


@pytest.mark.parametrize("name", ["make_target", "unlabelled_rows"])
def test_labelling_is_read_as_written(spark, name):
    # Export and corpus are made of lines, trees and codes that were written once; none is computed by both.
    files = plans.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any(t in f for f in files for t in ("documents", "orders", "lineitem", "embeddings"))


def test_labelling_moves_texts_once(spark, monkeypatch, tmp_path):
    # Zipped corpus, export and vectors were written and shuffled side by side, each with all its texts.
    rows = {
        "documents": ([(i, f"line {i}\nb c", "en", "s") for i in range(9)], "doc_id bigint, text string, lang string, source string"),
        "orders": ([(i, "O") for i in range(4)], "o_orderkey bigint, o_orderstatus string"),
        "lineitem": (
            [(i // 2, i % 2, i, i, "2024-01-01", 1.0, "N") for i in range(8)],
            "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_shipdate string, l_extendedprice double, l_returnflag string",
        ),
        "embeddings": ([(i, i % 2, [1.0, -1.0]) for i in range(5)], "vec_id bigint, label int, embedding array<float>"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    written = []

    def recorded(df):
        written.append(df.columns)
        return freeze(df)

    for module in (tables, jobs, plans.alignment):
        monkeypatch.setattr(module, "freeze", recorded)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = plans.queries()["make_target"](spark, str(tmp_path))
        found = made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 18 and {r["status"] for r in found} == {"merged"}
    assert sum("src" in columns for columns in written) == 1
    assert not any("vec" in columns for columns in written)
    run = "".join(part.split("== Initial Plan ==")[0] for part in plan.split("== Final Plan ==")[1:])
    for column in ("src", "cfg"):
        assert len(re.findall(rf"FileScan parquet \[line_no#\w+,{column}#", run)) == 1


def test_lost_lines_are_an_error_under_a_filter(spark):
    # The filter of the export took away the lines that one file lacks, before they were missed.
    src = spark.createDataFrame([(0, "a"), (1, "b")], "line_no bigint, src string")
    cfg = spark.createDataFrame([(0, "(S (A a))")], "line_no bigint, cfg string")
    vec = spark.createDataFrame([(i, [1.0]) for i in range(2)], "line_no bigint, vec array<double>")
    with pytest.raises(Exception, match="without counterpart: 1"):
        jobs.export_codes(src, cfg, vec, bits=1).collect()


def test_strict_zip_keeps_repeated_lines_and_names(spark):
    left = spark.createDataFrame([(0, "a"), (0, "b"), (1, None)], "line_no bigint, src string")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "line_no bigint, cfg string")
    zipped = alignment.strict_zip(left, right)
    assert zipped.columns == ["line_no", "src", "cfg"]
    assert sorted(map(str, zipped.collect())) == sorted(map(str, alignment.zip_lines(left, right).collect()))
    with pytest.raises(Exception, match="without counterpart"):
        alignment.strict_zip(left, right.union(spark.createDataFrame([(None, "z")], right.schema))).collect()
