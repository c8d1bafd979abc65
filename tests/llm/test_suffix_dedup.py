import os
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from weft.llm import induced, suffix_dedup


def some_text(rng, n):
    return "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))


def test_packed_columns_come_back():
    columns = [np.array([1 << 62, -7, -(1 << 63)]), np.array([], np.uint32), np.array([0, 255], np.uint8)]
    found = suffix_dedup.unpacked(suffix_dedup.packed(*columns), *(c.dtype for c in columns))
    assert [c.tolist() for c in found] == [c.tolist() for c in columns]
    steps = suffix_dedup._steps(columns[0])
    assert np.cumsum(steps).tolist() == columns[0].tolist()


def test_segments_take_few_bytes_beside_their_text():
    """A place in a text, its length and its name take less than 16 bytes in the shuffle."""
    rng = random.Random(1)
    texts = [some_text(rng, 3000) for _ in range(100)]
    places = sum(len(names) for _, _, names, *_ in suffix_dedup.named_runs([t.encode() for t in texts]))
    bodies = sum(int((end - begin).sum()) for *_, begin, end in suffix_dedup.named_runs([t.encode() for t in texts]))
    met = [
        np.concatenate([names >> np.uint64(32) for _, _, names, *_ in suffix_dedup.named_runs([t.encode()])])
        .astype(np.uint32).tobytes()
        for t in texts
    ]
    tags = np.random.default_rng(1).integers(0, 1 << 62, len(texts))
    batch = pa.RecordBatch.from_pydict(
        {"doc": pa.array(range(len(texts))), "tag": pa.array(tags), "nth": pa.array([0] * len(texts)), "text": texts, "met": pa.array(met, pa.binary()), "whole": [False] * len(texts)}
    )
    rows = [r for b in suffix_dedup._segments(1, 1)(iter([batch])) for r in b.to_pylist()]
    assert [r["kind"] for r in rows] == [2, 0]
    columns = suffix_dedup.unpacked(rows[1]["data"], *suffix_dedup._BODIES)
    assert len(columns[0]) == len(columns[4]) == places and len(columns[6]) == bodies
    alone = len(suffix_dedup.packed(columns[6]))
    assert len(rows[0]["data"]) + len(rows[1]["data"]) - alone < 16 * places


def test_bodies_of_one_hash_are_compared(monkeypatch):
    bodies = [b"ab", b"ac", b"ab", b"abc", b"ac"]
    data, lengths = np.frombuffer(b"".join(bodies), np.uint8), np.array([len(b) for b in bodies])

    def alike():
        which = suffix_dedup.classes(data, lengths)
        return [[x == y for y in which] for x in which]

    expected = [[x == y for y in bodies] for x in bodies]
    assert alike() == expected
    monkeypatch.setattr(suffix_dedup, "digests", lambda data, lengths: np.zeros(len(lengths), np.uint64))
    assert alike() == expected


def test_few_suffixes_open_no_file(tmp_path):
    text = np.frombuffer(b"some words and some words " * 20, np.uint8).astype(np.uint16) + 1
    assert sum(len(at) for at, _ in induced.sorted_suffixes(text, 50, str(tmp_path))) == len(text) + 1
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("small", [False, True])
def test_texts_of_one_id_keep_their_own_spans(spark, monkeypatch, small):
    if small:
        for name in ("CHUNK", "CHUNK_BYTES", "BUCKET", "SHARD_BYTES", "SPAN_BYTES", "STRETCH"):
            monkeypatch.setattr(suffix_dedup, name, 700)
    rng = random.Random(2)
    passages = [some_text(rng, 90) for _ in range(4)]
    rows = [(k, some_text(rng, 40) + p + some_text(rng, 70)) for k, p in enumerate(passages)]
    rows += [(9, some_text(rng, 30 + k) + passages[k % 4] + "é" * 60 + passages[(k + 1) % 4][:55]) for k in range(7)]
    rows += [(9, rows[-1][1]), (-3, rows[0][1][:80]), (1 << 62, rows[5][1] + rows[6][1]), (None, rows[0][1]), (5, None), (10, "a" * 400), (11, "a" * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(frame, keep=False).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.repeats(rows), key=repr)


def test_names_of_many_buckets_take_few_bytes():
    """Where a bucket has about one name of a text, whose name it is takes less than the name."""
    rng = random.Random(3)
    texts = [some_text(rng, 1500) for _ in range(400)]
    tags = np.random.default_rng(3).integers(0, 1 << 62, len(texts))
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(texts))), "tag": pa.array(tags), "text": texts})
    rows = [r for b in suffix_dedup._names(100)(iter([batch])) for r in b.to_pylist()]
    named = [suffix_dedup.unpacked(r["names"], *suffix_dedup._NAMED) for r in rows if r["kind"] != 2]
    names, owners = (sum(len(columns[k]) for columns in named) for k in (0, 1))
    assert owners > names / 2
    assert sum(len(r["names"]) - 56 for r in rows if r["kind"] != 2) < 8 * names


@pytest.mark.parametrize("byte", [None, 7])
def test_texts_of_one_id_may_share_the_byte_of_their_tags(spark, monkeypatch, byte):
    if byte is not None:
        monkeypatch.setattr(suffix_dedup, "_byte", lambda tags: np.full(len(tags), byte, np.uint8))
    rng = random.Random(4)
    passages = [some_text(rng, 90) for _ in range(5)]
    rows = [(k, some_text(rng, 40) + p) for k, p in enumerate(passages)]
    rows += [(9, some_text(rng, 30) + passages[k] + some_text(rng, 60)) for k in range(5)]
    rows += [(9, some_text(rng, 200)), (12, rows[6][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = suffix_dedup.remove_repeats(frame, keep=False).drop("kept").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.repeats(rows), key=repr)
