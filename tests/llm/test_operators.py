"""The ten operators against plain answers, with nulls, repeats, long and empty texts."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from weft.llm import (
    common, induced, jaccard, language, mixing, packing, quality, queries, secret_scan, sharding, suffix_dedup, topk,
    trigrams, warc,
)

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1. Language


def test_languages_of_held_out_texts(spark):
    found = queries.op1_language(spark, SF_DIR).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(found) == len(docs)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_language_of_odd_rows(spark, docs, no_docs):
    found = language.identify(docs, F.col("doc_id") % 5 == 0).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        if r.doc_id is None:
            continue
        letterless = not any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == letterless
        assert not letterless or (r.score == 0 and r.rejected)
    assert len(found) == docs.count()
    assert language.identify(no_docs, F.lit(False)).collect() == []
    nothing_learnt = language.identify(docs, F.lit(True)).collect()
    assert {r.lang_pred for r in nothing_learnt} == {"und"}


def test_features_ignore_case_and_marks():
    assert (language.features(b"Ab, cd") == language.features(b"aB... CD!")).all()
    assert language.features("12 - ٣".encode()) is None
    # Letters 2 and 2; pairs with word ends 3 and 3; triples that begin or end in one 2 and 2.
    assert language.features(b"ab cd").sum() == 4 + 6 + 4


# 2. Secrets


def test_secrets_equal_a_plain_scan(docs, texts):
    found = secret_scan.report(secret_scan.scan(docs))
    expected = []
    for i, t in texts:
        base = brute.secrets(t)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
        expected.append((i, *[sum(b[1] == n for b in base) for n in range(3)], digest))
    assert rows_of(found.drop("spans")) == sorted(expected, key=repr)


HARD = [
    "password=abc password=abcdef", "token=token:abcdefgh", 'API_KEY: "xx.yy=zz"', "api key=abcdef", "Secret = 'a-b_c/d+e'",
    "AKIAAKIA" + "A" * 16, "xAKIA" + "0" * 15, "f" * 23 + "g" + "0" * 24, "é" * 5 + "passwd:ééé token=ééé123456",
    "token=" + "0123456789abcdef" * 2, "", None,
]


def test_hard_secrets(spark):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in secret_scan.report(secret_scan.scan(docs)).collect():
        base = brute.secrets(HARD[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest(), HARD[r.doc_id]


def test_added_rules_and_masks(spark, no_docs):
    jwt = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12
    texts = ["ghp_" + "a" * 36 + " x", f"a {jwt} b", "-----BEGIN RSA PRIVATE KEY-----", "token=" + "ab12" * 8 + " end", "clean", None]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, kinds string")
    out = {r.doc_id: r for r in secret_scan.mask_documents(docs).collect()}
    assert [out[i].text for i in range(6)] == ["[SECRET] x", "a [SECRET] b", "[SECRET]", "[SECRET] end", "clean", None]
    assert out[0].n_chars == 10 and out[4].n_chars == 0 and out[0].kinds == "x"
    assert secret_scan.scan(no_docs).collect() == []


def test_private_keys_are_masked_whole(spark):
    lines = [hashlib.sha512(bytes([i])).hexdigest().upper().replace("0", "+").replace("1", "/").replace("2", "z")[:64] for i in range(40)]
    begin, end, body = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "\n".join([*lines, "Qx9="])
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F1E\n\n"
    key = f"{begin}\n{body}\n{end}"
    cases = {
        f"a {key} b": "a [SECRET] b",
        f"a {key}\nb {key} c": "a [SECRET]\nb [SECRET] c",
        f"{begin}\n{headers}{body}\n{end}\nb": "[SECRET]\nb",
        'k = "' + key.replace("\n", "\\n") + '"': 'k = "[SECRET]"',
        f"a\n{begin}\n{body}\nwords follow here": "a\n[SECRET]\nwords follow here",
        f"{begin}\n{headers}{body}": "[SECRET]",
        f"{begin}\n{body}\n-----BEGIN CERTIFICATE-----": "[SECRET]\n-----BEGIN CERTIFICATE-----",
        f"a line {begin} opens a key file": "a line [SECRET] opens a key file",
        f"{begin}\n" + (lines[0] + "\n") * 20000 + "so it ends": "[SECRET]\nso it ends",
    }
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(cases)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r.text for r in secret_scan.mask_documents(docs).collect()}
    assert [out[i] for i in range(len(cases))] == list(cases.values())
    assert trigrams.query(secret_scan.PRIVATE_KEY) == trigrams.query(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")


def test_trigram_queries():
    assert trigrams.query("[0-9a-f]{24,}") is None
    assert trigrams.query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert set(trigrams.query("(abcd|xyz?w)")) == {frozenset({"abc", "bcd"}), frozenset({"xyz", "yzw"}), frozenset({"xyw"})}
    assert trigrams.query("ab*c") is None
    assert trigrams.query("(?:abc)?def") == [frozenset({"def"})]


# 3. WARC


def test_archives_round_trip(spark, no_docs):
    pages = [(i, f"http://h/{i}?é=%20", f"<p>{'x' * (i % 4)} ü</p>" * (1 + i % 3)) for i in range(200)]
    pages += [(300, None, None), (301, "u\r\nv", ""), (None, "n", "<p>null</p>"), (5, pages[5][1], pages[5][2]), (302, "l", "long " * 300_000)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, sha1 string").repartition(3)
    folder = warc.new_folder(spark)
    manifest = warc.write_warc(frame, folder)
    for archives in (manifest, warc.archives_below(spark, folder)):
        back = warc.read_warc(archives).collect()
        first = {}
        for i, _, h in pages:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        expected = []
        for i, u, h in pages:
            least = first.get(h or "")
            again = least is not None and i != least
            payload = (h or "").encode()
            expected.append((
                i, u, "revisit" if again else "response", least if again else None, len(payload),
                base64.b32encode(hashlib.sha1(payload).digest()).decode(), b"" if again else payload,
            ))
        assert sorted(map(repr, (tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in back))) == sorted(map(repr, expected))
    empty = no_docs.selectExpr("doc_id AS page_id", "text AS url", "text AS html")
    assert warc.read_warc(warc.write_warc(empty, warc.new_folder(spark))).collect() == []


def test_archive_frames_and_faults():
    records = [warc.encode(i, "u", b"payload %d " % i * 50, hashlib.sha1(b"payload %d " % i * 50).digest(), None, False) for i in range(50)]
    out = io.BytesIO()
    warc.write_archive(out, records)
    raw = out.getvalue()
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.read_archive(io.BytesIO(raw))) == records
    assert list(warc.read_archive(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-3])))
    good = records[0]
    for bad in (good[:-1], good + b"x", good.replace(b"payload", b"Payload"), good.replace(b"WARC/1.1", b"WARC/9.9"),
                good.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.decode(bad)


# 4. Jaccard join


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
@pytest.mark.parametrize("sets", [1024, 3])
def test_components_equal_all_pairs(docs, texts, monkeypatch, n, num, den, sets):
    monkeypatch.setattr(jaccard, "TREE_SETS", sets)
    found = jaccard.similar(docs, n, num, den).collect()
    expected = brute.similar(texts, n, num, den)
    assert len(found) == len(texts)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]


def test_jaccard_of_nothing(no_docs):
    assert jaccard.similar(no_docs).collect() == []


def test_tree_links_equal_all_pairs():
    random.seed(3)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        base = [random.getrandbits(63) for _ in range(80)]
        sets = []
        for _ in range(150):
            keep = random.sample(base, random.randint(40, 80))
            sets.append(np.unique(np.array(keep + [random.getrandbits(63) for _ in range(random.randint(0, 8))], np.uint64)))

        def closure(links):
            root = list(range(len(sets)))
            for a, b in links:
                x, y = root[a], root[b]
                root = [x if r == y else r for r in root]
            return {frozenset(i for i, r in enumerate(root) if r == q) for q in set(root)}

        plain = [
            (i, j) for i in range(len(sets)) for j in range(i)
            if den * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j]))
        ]
        links = jaccard.forest(sets, num, den)
        assert len(links) < len(sets) and closure(links) == closure(plain)
        # Similar sets share a key.
        keys = [set(jaccard.signatures(s, num, den).tolist()) for s in sets]
        assert all(keys[i] & keys[j] for i, j in plain)


@pytest.mark.parametrize("num, den", [(9, 10), (4, 5), (1, 2)])
def test_similar_sets_share_a_key_at_every_size(num, den):
    rng = np.random.default_rng(num)
    for size in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(12 if size < 1000 else 2):
            one = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            # As many n-grams are taken away, or put in, or both, as similarity bears.
            out = int(rng.integers(0, len(one) * (den - num) // den + 1))
            kept = rng.permutation(one)[out:]
            more = (den * len(kept) - num * len(one)) // num
            more = int(rng.integers(0, max(more, 0) + 1))
            two = np.unique(np.concatenate((kept, rng.integers(0, 1 << 64, more, dtype=np.uint64))))
            both = len(np.intersect1d(one, two))
            if len(two) and den * both >= num * (len(one) + len(two) - both):
                assert np.isin(jaccard.signatures(one, num, den), jaccard.signatures(two, num, den)).any()


def test_keys_of_many_sets_pass_by(docs, texts, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LIST", 2)
    monkeypatch.setattr(jaccard, "CHUNK", 40)
    monkeypatch.setattr(jaccard, "TREE_SETS", 2)
    expected = brute.similar(texts, 3, 4, 5)
    found = [r for r in jaccard.similar(docs, 3, 4, 5).collect() if r.doc_id is not None]
    assert found and all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in found)


@pytest.mark.parametrize("num, den, share", [(9, 10, 0.02), (4, 5, 0.2)])
def test_passages_of_many_documents_make_no_long_lists(num, den, share):
    """A passage that all documents share, a fifth of each, brings a small share of them together.

    A part is the same in two of them if it has n-grams of the passage alone.
    """
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    keys = [
        jaccard.signatures(np.unique(np.concatenate((passage, rng.integers(0, 1 << 64, 240, dtype=np.uint64)))), num, den)
        for _ in range(400)
    ]
    _, counts = np.unique(np.concatenate(keys), return_counts=True)
    assert counts.max() < share * 400 and (counts > 1).sum() < 0.02 * len(counts)


def test_chains_of_sets(spark):
    """Each set is similar to its neighbours only; one component of more sets than a tree holds."""
    words = [f"w{i}" for i in range(3100)]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(3000)]
    rows += [(10_000 + i, " ".join(words[i : i + 100]) + f" x{i} y{i} z{i} v{i} u{i} t{i} s{i} r{i} q{i} p{i}" * 3) for i in range(0, 3000, 100)]
    found = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert all(r.component_id == (0 if r.doc_id < 10_000 else r.doc_id) for r in found)


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 200), (7, 3)]
    found = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# 5. Mixing


def filled(sizes, weights, share=1.5, repeats=2):
    """Targets by dealing the excess again and again."""
    targets, free, left = {}, set(sizes), share * sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        above = {s for s in free if left * weights[s] / total > repeats * sizes[s]}
        if not above:
            return targets | {s: left * weights[s] / total for s in free}
        targets |= {s: repeats * sizes[s] for s in above}
        left -= sum(repeats * sizes[s] for s in above)
        free -= above
    return targets


def test_mix_of_documents(spark, docs, no_docs):
    found = mixing.mix(docs, block_words=16).collect()
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 40 for s in names)
    again = mixing.mix(docs.repartition(1), block_words=16).collect()
    assert Counter((r.doc_id, r.taken) for r in found if r.doc_id not in (None, 50)) == Counter(
        (r.doc_id, r.taken) for r in again if r.doc_id not in (None, 50)
    )
    assert mixing.mix(no_docs).collect() == []


def test_mix_over_many_shards(docs):
    found = mixing.mix(docs, block_words=8, shard_words=500).collect()
    by_source = defaultdict(lambda: [0, 0.0])
    for r in found:
        by_source[r.source][0] += r.taken
        by_source[r.source][1] = r.target
    assert len({r.shard for r in found}) > 5
    # A shard's last block is shorter than the others: at most one block a shard is lost.
    assert all(abs(t - want) <= 8 * 40 for t, want in by_source.values())


@pytest.mark.parametrize("copies", [1, 40])
def test_mix_of_other_layouts(spark, docs, copies):
    rows = [tuple(r)[:5] for r in docs.collect() if copies > 1 or r.doc_id not in (None, 50)]
    rows += [(900, "a text that repeats", lang, "s0", n) for n, lang in enumerate(["en", "fr"] * (copies // 2))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    layouts = [spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame(rows[::-1], schema).repartition(7)]
    runs = [mixing.mix(d, block_words=8, shard_words=500).drop("__row").collect() for d in layouts]
    assert len({r.shard for r in runs[0]}) > 5
    assert Counter(runs[0]) == Counter(runs[1])
    if copies > 1:
        assert len({r.shard for r in runs[0] if r.doc_id == 900}) > 1
    mixed = [Counter(mixing.mixed_documents(d, block_words=8, shard_words=500).collect()) for d in layouts]
    assert mixed[0] == mixed[1]


def test_small_sources_of_many_shards(spark):
    rows = [(i, "word " * 200, "big") for i in range(300)] + [(1000 + i, "word " * 10, "small") for i in range(100)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=16, shard_words=500).collect()
    assert len({r.shard for r in found}) > 50
    for source in ("big", "small"):
        part = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 16


def seats(votes, n):
    """Seats of each party: the n highest quotients, ties by order."""
    ranked = sorted((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) if v for k in range(n))[:n]
    return [sum(r[1] == i for r in ranked) for i in range(len(votes))]


@pytest.mark.parametrize("part_blocks", [4, 1000])
def test_shards_give_whole_blocks_by_their_quotas(spark, docs, part_blocks):
    rows = [(1000 + i, "word " * (i % 40), f"s{i % 3}") for i in range(400)]
    more = spark.createDataFrame(rows, "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "source").union(more)
    found = mixing.shares(both, block_words=8, shard_words=500, part_blocks=part_blocks).collect()
    sources = {r.source: r.target for r in found}
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    names_null_first = sorted(sources, key=lambda s: (s is not None, s or ""))
    wanted = seats([sources[s] for s in names_null_first], round(sum(sources.values()) / 8))
    quotas = dict(zip(names_null_first, wanted))
    n_parts, orders = 0, set()
    for s in names:
        parts = {r.part: (r.words, r.part_quota, r.rounds) for r in found if r.source == s}
        n_parts += len(parts)
        assert [parts[p][1] for p in sorted(parts)] == seats([parts[p][0] for p in sorted(parts)], quotas[s])
        for p, (words, quota, rounds) in parts.items():
            mine = sorted((r for r in found if r.source == s and r.part == p and r.size), key=lambda r: r.start)
            assert [r.start for r in mine] == [sum(q.size for q in mine[:k]) for k in range(len(mine))]
            due = min(8 * quota, 2 * words)
            assert rounds == (due // words if words else 0)
            given = Counter(r.start + k for r in mine for piece in r.pieces for k in range(piece["from"], piece["to"]))
            assert sum(given.values()) == due - rounds * words and set(given.values()) <= {1}
            blocks = Counter(k // 8 for k in given)
            cut = [b for b, n in blocks.items() if n < min(8, words - 8 * b)]
            assert len(cut) <= 1 and all(b * 8 + k in given for b in cut for k in range(blocks[b]))
            orders.add(tuple(sorted(blocks)) == tuple(range(len(blocks))))
            assert all(r.extra == sum(x["to"] - x["from"] for x in r.pieces) and r.taken == r.size * rounds + r.extra for r in mine)
    assert len(found) == both.count() and False in orders
    # Parts of 1,000 blocks are whole sources here, but where a long text starts a second one.
    assert n_parts > 40 if part_blocks == 4 else len(names) <= n_parts <= len(names) + 3
    other = mixing.shares(both, block_words=8, shard_words=500, part_blocks=part_blocks, seed=1).collect()
    assert sorted((str(r.doc_id), r.taken) for r in other) != sorted((str(r.doc_id), r.taken) for r in found)


def test_mixed_documents_give_the_words_of_their_blocks(spark):
    rows = [(i, " ".join(f"{i}.{k}" for k in range(50)), "a" if i % 2 else "b", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").coalesce(1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in mixing.shares(docs, block_words=8).collect()}
    mixed = defaultdict(list)
    for r in mixing.mixed_documents(docs, block_words=8).collect():
        mixed[r.doc_id].append(r.text)
    for i, r in found.items():
        words = texts[i].split()
        extra = [w for x in r.pieces for w in words[x["from"] : x["to"]]]
        assert sorted(t.split() for t in mixed[i]) == sorted([words] * r.rounds + [extra] * bool(extra))


def test_mixed_documents(docs):
    shares = mixing.mix(docs.withColumnRenamed("__row", "other")).filter("doc_id is not null and doc_id != 50")
    mixed = mixing.mixed_documents(docs.drop("__row"))
    assert mixed.columns == docs.drop("__row").columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert sum(words.values()) > 0 and all(words[r.doc_id] <= 2 * r.size for r in shares.collect())


def test_seats_go_to_the_highest_quotients(spark):
    random.seed(5)
    for n, seats in ((1, 7), (4, 3), (12, 100), (30, 11)):
        votes = [random.choice([0, random.randint(1, 1000), 10]) for _ in range(n)]
        votes[0] += 1
        frame = spark.createDataFrame([("g", i, float(v), seats) for i, v in enumerate(votes)], "g string, i int, v double, s long")
        found = {r.i: r.won for r in mixing.apportion(frame, ["g"], ["i"], "v", "s", "won").collect()}
        ranked = sorted(((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        assert found == {i: sum(r[1] == i for r in ranked) for i in range(n)}


# 6. Shards


def test_shards_and_slots(docs, texts, no_docs):
    found = sharding.shard_documents(docs).collect()
    assert len(found) == len(texts)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == expected
    by_key = defaultdict(set)
    for r in found:
        by_key[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_key.values())
    assert sharding.shard_documents(no_docs).collect() == []


def test_weights_and_growth(spark):
    keys = spark.range(20_000).select(
        sharding.rendezvous([F.col("id")], [1, 2, 1]).alias("a"), sharding.rendezvous([F.col("id")], [1, 2, 1, 4]).alias("b")
    )
    rows = keys.collect()
    share = Counter(r.a for r in rows)
    assert abs(share[1] / 20_000 - 0.5) < 0.02
    assert all(r.a == r.b or r.b == 3 for r in rows)
    assert abs(sum(r.b == 3 for r in rows) / 20_000 - 0.5) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous([F.col("id")], [1, 0])


# 7. Quality


def test_quality_counts(docs, texts, no_docs):
    found = quality.assess(docs)
    cases = [(i, *brute.quality(t)) for i, t in texts if len(t or "") < 5000]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(found.filter("n_words < 5000").select(*names)) == sorted(cases, key=repr)
    assert found.filter("kept AND base_failed").count() == 0 and found.count() == len(texts)
    assert quality.assess(no_docs).collect() == []


def test_line_rules():
    clean = "This is a sentence of plain words, with marks (and more)."
    for line in (clean, "Yes!", "", "   ", "Call 555-0100 or mail a@b.org today please.", "a b c"):
        assert not quality.line_fails(line.encode()), line
    for line in ("=====", "* * * *", "Home | About | Contact", "News » Sport » Football", "All Rights Reserved.", "We!!! are!!! so!!! loud!!! here!!!"):
        assert quality.line_fails(line.encode()), line
    good = "\n".join([" ".join(f"word{i}x{k}" for i in range(20)) for k in range(5)])
    assert quality.judge(good.encode())[6] and quality.judge((good + "\nAll rights reserved.").encode())[9] == good.encode()
    noise = "\n".join(["Home | About | Contact us"] * 3 + [f"Home {k} | About | Shop" for k in range(30)])
    assert not quality.judge((good + "\n" + noise).encode())[6]


def test_long_clean_lines_may_mention_a_phrase():
    words = [f"word{i}" for i in range(100)]
    for phrase in ("privacy policy", "All rights reserved", "click here to"):
        line = " ".join([*words[:60], phrase, *words[60:]]).encode()
        assert not quality.line_fails(line), phrase
        assert quality.judge(line)[6] and quality.judge(line)[9] == line
        paragraphs = b"\n".join([" ".join(f"p{i}x{k}" for i in range(80)).encode() for k in range(5)] + [line])
        assert quality.judge(paragraphs)[9] == paragraphs
        assert quality.line_fails(" ".join([*words[:20], phrase]).encode()), phrase
        assert quality.line_fails(" ".join([phrase] * 30 + words[:10]).encode()), phrase


def test_quality_filter_keeps_columns(docs, texts):
    kept = quality.filter_documents(docs)
    assert kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        i for i, t in texts if quality.judge((t or "").encode())[6]
    )


# 8. Suffix dedup


def plain_suffixes(text, limit):
    order = sorted(range(len(text) + 1), key=lambda i: text[i : i + limit])
    return [text[i : i + limit] for i in order]


@pytest.mark.parametrize("batch, waiting", [(1 << 18, 1 << 12), (5, 2)])
def test_induced_order(tmp_path, monkeypatch, batch, waiting):
    monkeypatch.setattr(induced, "BATCH", batch)
    monkeypatch.setattr(induced, "RUN", batch)
    monkeypatch.setattr(induced, "WAITING", waiting)
    random.seed(2)
    cases = [bytes(random.choice(b"ab~") for _ in range(random.randint(0, 60))) for _ in range(60)] + [b"a" * 90, b"ab" * 40]
    for k, text in enumerate(cases):
        folder = tmp_path / str(k)
        folder.mkdir()
        limit = (3, 50)[k % 2]
        parts = list(induced.sorted_suffixes(np.frombuffer(text, np.uint8).astype(np.uint16) + 1, limit, str(folder)))
        at, lcp = (np.concatenate(c).tolist() for c in zip(*parts))
        heads = [text[i : i + limit] for i in at]
        assert sorted(at) == list(range(len(text) + 1)) and heads == plain_suffixes(text, limit)
        common_of = [next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(heads, heads[1:])]
        assert lcp[1:] == common_of


@pytest.mark.parametrize("chunk", [None, 200])
def test_repeats_equal_a_table_of_strings(docs, texts, monkeypatch, chunk):
    if chunk:
        for name, value in (("CHUNK", chunk), ("CHUNK_BYTES", 50 * chunk), ("BUCKET", chunk), ("SHARD_BYTES", 50 * chunk), ("PIECE", 300)):
            monkeypatch.setattr(suffix_dedup, name, value)
    found = suffix_dedup.remove_repeats(docs)
    assert rows_of(found.drop("kept")) == sorted(brute.repeats(texts), key=repr)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found.collect())


def test_repeats_of_nothing(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).collect() == []


# 9. Packing


def ids_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_pieces_and_sequences(docs, texts, no_docs):
    path = queries.tokenizer_path()
    found = packing.pack_documents(docs, path).collect()
    expected = Counter()
    for (i, _), ids in zip(texts, ids_of([t for _, t in texts])):
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            expected[(i, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack_documents(no_docs, path).collect() == []


def test_words_by_memory_equal_the_tokenizer():
    encoder = packing.WordEncoder(queries.tokenizer_path())
    odd = [
        "Don't stop. it's 3.14, naïve!!", "a b c", "<|endoftext|> x<|startoftext|>.", "é É, É.", "ΑΣ ΑΣ. İstanbul",
        "漢字、かな。 １２ x²", "—, word—, “quoted.”", "\x00\x1c a\x85b", "tab\tnew\nline\x0bv\x0cf\rr", "😀😀. a😀b!", "''s 's't", "",
    ]
    random.seed(4)
    odd += ["".join(random.choice("aé.,!' 'sΣ1<|>́ ") for _ in range(40)) for _ in range(300)]
    ids = [np.array(i[:-1], "<u4").tobytes() for i in ids_of(odd)]
    assert encoder.encode([t.encode() for t in odd]) == ids
    assert encoder.encode([t.encode() for t in odd]) == ids


def test_packing_is_tight():
    random.seed(6)
    for lengths in (
        np.array([random.randint(1, 4096) for _ in range(3000)]), np.array([2048] * 101 + [1365] * 90), np.array([4096] * 5),
        np.array([random.choice([900, 1300, 2100]) for _ in range(2000)] + [random.randint(1, 300) for _ in range(2000)]),
        np.array([1]), np.array([], np.int64),
    ):
        sequence, offset = packing.pack(lengths)
        used = defaultdict(int)
        for s, o, n in sorted(zip(sequence, offset, lengths)):
            assert used[s] == o
            used[s] += n
        assert all(u <= 4096 for u in used.values())
        # No more than the plain best fit by falling length needs, but for roundings.
        rooms = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [k for k, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= n
            else:
                rooms.append(4096 - n)
        assert len(used) <= 1.02 * len(rooms) + 1


# 10. Top-k


def test_top_k_equals_a_full_product(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(500)]
    vectors += [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (None, [1.0]), (504, []), (505, [2.0]), (506, [0.0] * 8)]
    vectors += [(507, vectors[3][1])] * 2
    frame = spark.createDataFrame([(i, v, 9) for i, v in vectors], "vec_id long, embedding array<double>, score int").repartition(4)
    found = defaultdict(list)
    for r in topk.top_k(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, w in ints:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in ints if i != q)[:10]
            assert found.pop(q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not found
    assert topk.top_k(frame.limit(0), F.lit(True)).collect() == []
    assert topk.top_k(frame, F.lit(False)).collect() == []


def test_top_k_over_blocks(spark, monkeypatch):
    frame = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    whole = rows_of(topk.top_k(frame, F.col("vec_id") % 10 == 0))
    monkeypatch.setattr(topk, "BLOCK", 17)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    assert rows_of(topk.top_k(frame, F.col("vec_id") % 10 == 0)) == whole


def test_a_key_has_one_shard_in_any_type(spark):
    ids = spark.range(300).select("id", F.col("id").cast("int").alias("small"), F.col("id").cast("string").alias("text"))
    found = ids.select(*[sharding.rendezvous([F.col(c)], [1.0] * 8).alias(c) for c in ids.columns]).collect()
    assert all(len(set(r)) == 1 for r in found) and {r["id"] for r in found} == set(range(8))


def test_rows_of_one_id_with_equal_checksums(spark):
    """Texts of one CRC-32 under one id: only the text that repeats an earlier document is cut."""
    rng = random.Random(4)
    seen = {}
    while True:
        text = "".join(rng.choice("abcdefghij") for _ in range(60))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            break
    rows = [(1, other), (5, other), (5, text)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=False).drop("kept")
    assert rows_of(got) == sorted(brute.repeats(rows), key=repr)


def test_words_are_those_of_the_tokenizer():
    encoder = packing.WordEncoder(queries.tokenizer_path())
    words = ["one", "one,###", "Été.", "straße&&&", "İ.", "İ", "ab<|endoftext|>", "AB<|ENDOFTEXT|>.", "a<|", "it's.", "x1#", "ΑΣ.", "á,"]
    texts = [*words, " ".join(words), "ONE  one.\n" + " ".join(words[::-1])]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_that_come_again_are_not_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    encoder, learnt = packing.WordEncoder(queries.tokenizer_path()), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: (learnt.extend(words), learn(words))[1])
    for i in range(60):
        encoder.encode([b"often " + " ".join("abcdefghij"[int(d)] for d in f"{i:03d}").encode() + b"q%d" % i])
    assert learnt.count(b"often") == 1
    assert len(encoder.words) + len(encoder.older) < 80
