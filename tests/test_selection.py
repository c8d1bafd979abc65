"""n-best parsing and selection against golden values and a plain walk."""

import itertools

import pytest
from pyspark.sql import functions as F

from weft.operators import selection

SCHEMA = "block string, rank bigint, code string, sent string"


def walk(codes, k=3):
    """Ranks of the best choice of ``k`` candidates among all choices, by the rule itself.

    The first candidate of each code counts as new, every other one as a repeat, one
    without code as worst. The best choice has the fewest without code, then the fewest
    repeats, then the lowest ranks.
    """
    new = {code: rank for rank, code in reversed(list(enumerate(codes))) if code is not None}
    cost = [(code is None, code is not None and new[code] != rank, rank) for rank, code in enumerate(codes)]
    # Costs are told apart by rank, so the best choice is that of the lowest costs.
    small = sorted(range(len(codes)), key=cost.__getitem__)[: max(k, 2 * k)]
    choices = itertools.combinations(sorted(small), min(k, len(codes)))
    return list(min(choices, key=lambda choice: sorted(cost[r] for r in choice)))


def frame(spark, blocks):
    rows = [
        (name, rank, code, f"s{rank}") for name, codes in blocks.items() for rank, code in enumerate(codes)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def kept(df):
    found = {}
    for row in df.orderBy("block", "pos").collect():
        found.setdefault(row["block"], []).append(row["rank"])
    return found


@pytest.mark.parametrize(
    "codes, ranks",
    [
        ("a a a", [0, 1, 2]),
        ("a a a b c", [0, 3, 4]),
        ("a b a c", [0, 1, 3]),
        ("a a b b", [0, 1, 2]),
        ("- - a", [0, 1, 2]),
        ("- - - a", [0, 1, 3]),
        ("- a a a b", [1, 2, 4]),
        ("a - a b", [0, 2, 3]),
        ("a b", [0, 1]),
    ],
)
def test_golden(spark, codes, ranks):
    codes = [None if c == "-" else c for c in codes.split()]
    assert walk(codes) == ranks
    assert kept(selection.diverse_top(frame(spark, {"x": codes}))) == {"x": ranks}


def test_equals_walk_on_all_small_blocks(spark):
    blocks = {
        "/".join(map(str, codes)): codes
        for n in range(1, 7)
        for codes in itertools.product(["a", "b", "c", None], repeat=n)
    }
    found = kept(selection.diverse_top(frame(spark, blocks)))
    assert found == {name: walk(list(codes)) for name, codes in blocks.items()}


def test_hot_block_and_counts(spark):
    codes = [None if i % 3 == 0 else f"c{i % 40}" for i in range(3000)]
    df = frame(spark, {"hot": codes, "small": ["a", "b"]})
    assert kept(selection.diverse_top(df)) == {"hot": walk(codes), "small": [0, 1]}
    counts = {r["block"]: r["n_kept"] for r in selection.diverse_top(df).collect()}
    assert counts == {"hot": 3, "small": 2}
    stats = {r["block"]: (r["n_rows"], r["n_without_code"], r["n_codes"]) for r in selection.block_code_stats(df).collect()}
    assert stats == {"hot": (3000, 1000, len({c for c in codes if c})), "small": (2, 0, 2)}


def test_parse_modes(spark):
    lines = spark.createDataFrame([(0, "0|||<c1><eoc>hi</s>|||f|||-1"), (1, "broken|||line")], "rank bigint, value string")
    good = selection.parse_nbest(lines, mode="DROPMALFORMED").collect()
    assert [(r["block"], r["code"], r["sent"]) for r in good] == [("0", "<c1>", "hi")]
    assert [r["rank"] for r in selection.nbest_rejects(lines).collect()] == [1]
    with pytest.raises(Exception, match="four-field"):
        selection.parse_nbest(lines).collect()


def test_output_line_has_no_separator(spark):
    df = frame(spark, {"x": ["<c1>", None]})
    lines = [r["l"] for r in df.orderBy("rank").select(selection.triple_line().alias("l")).collect()]
    assert lines == ["<c1>s0", "NULLs1"]


def test_new_codes(spark):
    held, offered = frame(spark, {"x": ["a", "b"]}), frame(spark, {"x": ["b", "c", "c"]})
    assert [r["code"] for r in selection.new_codes(held, offered).collect()] == ["c"]


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_runs_across_slices(spark, bits):
    keys = list("aabbbacccccaab") + [None, None, "a"]
    gap = [i * (3 if i > 6 else 1) for i in range(len(keys))]  # line numbers with holes
    df = spark.createDataFrame(list(zip(gap, keys)), "line_no bigint, idx string")
    found = [r["block_no"] for r in selection.blocks_by_run(df, "idx", slice_bits=bits).orderBy("line_no").collect()]
    expected, last = [], object()
    for key in keys:
        expected.append(expected[-1] + (key != last) if expected else 0)
        last = key
    assert found == expected


def test_limits_stand_on_both_sides_of_the_shuffle(spark):
    plan = selection.diverse_top(frame(spark, {"x": ["a"]}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 2 and plan.count("WindowGroupLimit") >= 4


def test_plain_top(spark):
    df = frame(spark, {"x": list("abcde"), "y": ["a"]})
    assert kept(selection.nbest_top(df)) == {"x": [0, 1, 2], "y": [0]}
    assert df.filter(F.col("block") == "x").count() == 5
