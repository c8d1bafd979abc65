"""Readers and writers on files."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from weft.operators import batching, jobs, vocabulary
from weft.sources import commit, corpus, sinks


def write(path, lines, end="\n"):
    path.write_text("\n".join(lines) + end, encoding="utf-8")
    return str(path)


def text_of(spark, path):
    """The committed lines, by their own numbers and as they stand in the files."""
    path = str(path)
    rows = sorted(corpus.read_committed(spark, path).select("line_no", "text").collect())
    assert [r["line_no"] for r in rows] == list(range(len(rows)))
    files = [name.removeprefix("file:") for name in commit.committed_files(spark, path, corpus.LINES)]
    assert [r["text"] for r in rows] == [line for name in files for line in open(name, encoding="utf-8").read().splitlines()]
    return [r["text"] for r in rows]


def test_line_numbers_over_files_and_splits(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    for name, n in (("b.txt", 1200), ("a.txt", 3000), ("c d%20é.txt", 5)):
        write(tmp_path / name, [f"{name} {i} " + "x" * (i % 40) for i in range(n)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        lines = corpus.read_lines(spark, str(tmp_path))
        # The splits of the definition are not those of the action.
        spark.conf.set("spark.sql.files.maxPartitionBytes", 30_000)
        rows = lines.orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [f"{name} {i} " + "x" * (i % 40) for name, n in (("a.txt", 3000), ("b.txt", 1200), ("c d%20é.txt", 5)) for i in range(n)]
    assert [r["text"] for r in rows] == expected
    assert [r["line_no"] for r in rows] == list(range(len(expected)))


def test_unterminated_line_and_gzip(spark, tmp_path):
    path = write(tmp_path / "x.txt", ["a", "", "c"], end="")
    assert corpus.read_lines(spark, path).count() == 3
    assert corpus.count_terminated(spark, path) == 2
    both = [path, write(tmp_path / "y.txt", ["a", "b\r"]), write(tmp_path / "mark.txt", ["\ufeffa", "é"], end=""), write(tmp_path / "no.txt", [], end="")]
    assert corpus.count_terminated(spark, both) == 5
    assert corpus.count_terminated(spark, both[3]) == 0
    with gzip.open(tmp_path / "z.gz", "wt") as f:
        f.write("p\nq\n")
    with pytest.raises(Exception, match="not a plain text file"):
        corpus.count_terminated(spark, str(tmp_path / "z.gz"))
    rows = corpus.read_lines(spark, str(tmp_path / "z.gz"), partitions=3).orderBy("line_no").collect()
    assert [(r["line_no"], r["text"]) for r in rows] == [(0, "p"), (1, "q")]


def test_pairs_and_tsv(spark, tmp_path):
    src = write(tmp_path / "s", [" a ", "b", "c"])
    tgt = write(tmp_path / "t", ["x", "y"])
    assert [(r["src"], r["tgt"]) for r in corpus.read_pairs(spark, src, tgt).orderBy("line_no").collect()] == [("a", "x"), ("b", "y")]
    tsv = write(tmp_path / "p.tsv", ['say "hi\tich', "b\t"])
    assert [(r["src"], r["tgt"]) for r in corpus.read_tsv_pairs(spark, tsv).collect()] == [('say "hi', "ich"), ("b", None)]


def test_vocabulary_files(spark, tmp_path):
    path = write(tmp_path / "c.txt", ["1\tthe cat", "2\tthe dog"])
    tokens = corpus.read_tokens(spark, path, field=1)
    vocab = vocabulary.build_vocab(tokens)
    sinks.save_vocab(vocab, str(tmp_path / "v"))
    again = corpus.load_vocab(spark, str(tmp_path / "v"))
    assert sorted(again.collect()) == sorted(vocab.collect())
    listed = [r["token"] for r in vocabulary.token_list(again).collect()]
    from_text = corpus.load_vocab(spark, write(tmp_path / "v.txt", listed), text=True)
    assert [r["token"] for r in vocabulary.token_list(from_text).collect()] == listed
    chars = vocabulary.build_vocab(corpus.read_tokens(spark, path, field=1, chars=True))
    assert chars.filter("token = 't'").first()["cnt"] == 3


def test_nbest_to_triples(spark, tmp_path):
    lines = [f"{b}|||{c}<eoc> s{i}</s>|||f|||0" for i, (b, c) in enumerate([(0, "a"), (0, "a"), (0, "a"), (0, "b"), (1, "x"), (0, "z")])]
    path = write(tmp_path / "n", lines)
    jobs.select_diverse(spark, path, str(tmp_path / "out"))
    # Block 0 comes back after block 1 and is a block of its own.
    assert text_of(spark, tmp_path / "out.en.filtered") == ["a s0", "a s1", "b s3", "x s4", "z s5"]
    with pytest.raises(Exception, match="four-field"):
        corpus.read_nbest(spark, write(tmp_path / "bad", ["1|||x"])).collect()


def test_export_and_target_files(spark, tmp_path):
    src = spark.createDataFrame([(0, "a "), (1, "b"), (2, "c " * 70)], "line_no bigint, src string")
    cfg = spark.createDataFrame([(0, "(S (A a))"), (1, "broken"), (2, "(S (A a))")], "line_no bigint, cfg string")
    vec = spark.createDataFrame([(i, [1.0, -1.0, 1.0]) for i in range(3)], "line_no bigint, vec array<double>")
    codes = jobs.export_codes(src, cfg, vec, bits=3)
    weights = spark.createDataFrame([(0, [0.0, 0.0, 2.0], -1.0), (1, [1.0, 1.0, 0.0], 0.0), (2, [1.0, 0.0, 0.0], 0.0)], "bit int, weights array<double>, bias double")
    assert [r["code"] for r in jobs.export_codes(src, cfg, vec, weights=weights).collect()] == ["5"]
    sinks.write_codes(codes, str(tmp_path / "codes"))
    assert text_of(spark, tmp_path / "codes") == ["a\t(S (A a))\t5"]
    target = spark.range(500).select(F.col("id").alias("line_no"), F.concat(F.lit("l"), "id").alias("line"))
    sinks.write_target(target.repartition(7), str(tmp_path / "tgt"))
    assert text_of(spark, tmp_path / "tgt") == [f"l{i}" for i in range(500)]


def test_shards_and_manifest(spark, tmp_path):
    df = spark.range(1025).select(F.col("id").alias("line_no"), F.concat(F.lit("l"), "id").alias("text"))
    sinks.write_shards(batching.shard(df, 10), str(tmp_path / "shards"))
    listing = corpus.shard_manifest(spark, str(tmp_path / "shards"))
    named = [(r["task_id"], r["path"].split("shard=")[1].split("/")[0]) for r in listing.orderBy("task_id").collect()]
    assert named == [(i + 1, f"{i:02d}") for i in range(103)]
    for task in (2, 101, 103):
        lines = [r["text"] for r in corpus.read_shard(spark, listing, task).orderBy("line_no").collect()]
        assert lines == [f"l{i}" for i in range(10 * task - 10, min(10 * task, 1025))]
    with pytest.raises(ValueError):
        corpus.read_shard(spark, listing, 999)
    folder = tmp_path / "plain"
    folder.mkdir()
    for name in ("b", "a"):
        write(folder / name, [name])
    plain = corpus.manifest(spark, str(folder)).orderBy("task_id").collect()
    assert [(r["task_id"], r["path"][-1]) for r in plain] == [(1, "a"), (2, "b")]
    trees = corpus.read_trees(spark, write(tmp_path / "t.cfg", ["(S (A a))"]))
    assert trees.collect() == [(0, "(S (A a))")]
    sinks.write_lines(df, str(tmp_path / "lines"))
    assert text_of(spark, tmp_path / "lines") == [f"l{i}" for i in range(1025)]


def test_only_commits_are_read(spark, tmp_path):
    path = str(tmp_path / "x")
    with pytest.raises(FileNotFoundError):
        corpus.read_committed(spark, path)
    df = spark.createDataFrame([(0, "a"), (1, "b")], "line_no bigint, text string")
    sinks.write_lines(df, path)
    with pytest.raises(Exception, match="line end"):
        sinks.write_lines(df.withColumn("text", F.lit("x\ny")), path)
    # An attempt that broke off, and one that nobody committed.
    broken = next(d for d in os.listdir(tmp_path / "x" / "attempts"))
    os.makedirs(tmp_path / "x" / "attempts" / "other" / "lines")
    write(tmp_path / "x" / "attempts" / "other" / "lines" / "part-0.txt", ["never"])
    write(tmp_path / "x" / "attempts" / broken / "lines" / "part-9.txt", ["late"])
    assert text_of(spark, path) == ["a", "b"]
    sinks.write_lines(df.withColumn("text", F.upper("text")), path)
    assert text_of(spark, path) == ["A", "B"]
    sinks.write_lines(df.limit(0), path)
    assert text_of(spark, path) == []


def test_changed_files_are_found(spark, tmp_path):
    path = str(tmp_path / "x")
    sinks.write_lines(spark.range(50).select(F.col("id").alias("line_no"), F.col("id").cast("string").alias("text")), path)
    commit.verify(spark, path, corpus.LINES)
    name = commit.committed_files(spark, path, corpus.LINES)[0].removeprefix("file:")
    os.remove(os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc"))
    whole = open(name).read()
    open(name, "w").write(whole.replace("3", "4", 1))
    with pytest.raises(ValueError, match="not as it was committed"):
        commit.verify(spark, path, corpus.LINES)


def test_metric_tables_in_one_commit(spark, tmp_path):
    lines = spark.createDataFrame([(3,), (4,), (5,)], "line_no long")
    scores = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "block long, bleu0 double, bleu1 double, bleu2 double")
    sinks.write_metrics(str(tmp_path / "m"), lines, scores, scores.limit(0))
    found = [sorted(df.collect()) for df in sinks.read_metrics(spark, str(tmp_path / "m"))]
    assert found == [[(3,), (4,), (5,)], [(1, 1.0, 2.0, 3.0)], []]
