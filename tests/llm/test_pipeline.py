"""The pipeline stage by stage against plain answers, and its queries against their SQL."""

from __future__ import annotations

from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pytest
from oracle_check import connect, rows_of
from weft.llm import mixing, quality, queries, secret_scan

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_stages(spark, documents):
    docs, columns = documents, documents.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "secrets", "mixture", "packed"]

    passed = stages["quality_rules"](spark, docs, SF_DIR).cache()
    judged = {r.doc_id: quality.judge(r.text.encode()) for r in docs.collect()}
    assert {r.doc_id: r.text for r in passed.collect()} == {i: v[9].decode() for i, v in judged.items() if v[6]}

    single = stages["near_duplicates"](spark, passed, SF_DIR).cache()
    groups = brute.similar([(r.doc_id, r.text) for r in passed.collect()], 5, 4, 5)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in groups.values()})

    clean = stages["secrets"](spark, single, SF_DIR).cache()
    assert clean.count() == single.count()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert not brute.secrets(r.text) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or secret_scan.MASK in r.text

    mixed = stages["mixture"](spark, clean, SF_DIR).cache()
    taken = {r.doc_id: r.taken for r in mixing.mix(clean).collect()}
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert dict(words) == {i: t for i, t in taken.items() if t}

    for frame in (passed, single, clean, mixed):
        assert frame.columns == columns
    out = stages["packed"](spark, mixed, SF_DIR).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())
    room = defaultdict(int)
    for r in out:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 4096 and np.mean(list(room.values())) > 3500
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert Counter(tuple(r)[:5] for r in whole.collect()) == Counter(tuple(r)[:5] for r in out)


def test_stages_of_nothing(spark, documents):
    docs = documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).collect() == [], name


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_rows_equal_sql(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    cursor = connect(SF_DIR).execute(queries.ORACLE[name])
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == expected


def test_mixture_does_not_write_its_input_again(spark, documents, monkeypatch):
    written, freeze = [], mixing.freeze
    monkeypatch.setattr(mixing, "freeze", lambda df: (written.append(df.columns), freeze(df))[1])
    mixed = corpus_pipeline.mixture(spark, documents, SF_DIR)
    assert written and not any("text" in columns for columns in written)
    assert Counter(mixed.collect()) == Counter(mixing.mixed_documents(documents).collect())
    # Rows of a file that come twice have no place of their own.
    twice = documents.join(spark.range(2), documents.doc_id >= 0)
    assert Counter(corpus_pipeline.mixture(spark, twice, SF_DIR).collect()) == Counter(mixing.mixed_documents(twice).collect())
