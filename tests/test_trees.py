"""Bracket trees: golden node tables and odd input."""

import pytest
from pyspark.sql import functions as F

from weft.operators import trees as op
from weft.operators import loading, vocabulary

CAT = "(ROOT (S (NP (DT the) (NN cat)) (VP (VBD sat)) (.)))"
DEEP = "(ROOT (A (B (C (D (E e)) (F f)) (G g)) (H h)))"
WIDE = "(ROOT (S " + " ".join(["(X (Y y))"] * 11) + "))"


def table(spark, *cfgs):
    return spark.createDataFrame(list(enumerate(cfgs)), "line_no bigint, cfg string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("line_no", "node_id").collect()]


def test_golden_nodes(spark):
    found = rows(
        op.nodes(table(spark, CAT)),
        "node_id", "parent_id", "enc_label", "dec_label", "y", "pos", "depth", "mask",
    )
    assert found == [
        (0, None, "S_1", "ROOT_1", "S_1", 0, 0, 1),
        (1, 0, "NP_1", "S_1", "NP_1", 0, 1, 0),
        (2, 0, "VP_1", "S_2", "VP_1", 1, 1, 0),
        (3, 0, "._1", "S_3", "._1", 2, 1, 0),
    ]


@pytest.mark.parametrize(
    "cfg, limit, nodes",
    [
        (WIDE, 0, ["S 0 0 0"]),
        ("(ROOT (NN dog))", 0, ["NN 0 0 0"]),
        (DEEP, 0, ["A 0 0 0", "B 1 0 1", "C 2 0 2", "D 3 0 3", "F 3 1 4", "G 2 1 5", "H 1 1 6"]),
        (DEEP, 2, ["A 0 0 0", "B 1 0 1", "C 2 0 2", "G 2 1 3", "H 1 1 4"]),
        (DEEP, 1, ["A 0 0 0", "B 1 0 1", "H 1 1 2"]),
        # Two children: the wrapper stays.
        ("(ROOT (A (X (B b))) (C c))", 0, ["ROOT 0 0 0", "A 1 0 1", "X 2 0 2", "C 1 1 3"]),
        # A node whose children are all tags with words is not expanded, its sibling is.
        ("(S (N (D d) (N n)) (V (P (Q q))))", 0, ["S 0 0 0", "N 1 0 1", "V 1 1 2", "P 2 0 3"]),
        # No label; white space inside of brackets.
        ("( (S (A (B b)) ( C c )))", 0, [" 0 0 0", "S 1 0 1", "A 2 0 2", "C 2 1 3"]),
    ],
)
def test_expansion(spark, cfg, limit, nodes):
    df = op.nodes(table(spark, cfg), limit).withColumn("label", F.regexp_replace("enc_label", "_1$", ""))
    assert [" ".join(map(str, r)) for r in rows(df, "label", "depth", "pos", "node_id")] == nodes


BAD = ["", "   ", "(", ")", "(S (A a)", "(S (A a)))", "(A a) (B b)", "x (A a)", "(A a) x", "(SX)", "(SX (AB))", "word", None]


def test_validity(spark):
    df = table(spark, CAT, DEEP, WIDE, "(S a b)", "(S a (B b))", *BAD)
    valid = [r["line_no"] for r in df.filter(op.is_valid("cfg")).orderBy("line_no").collect()]
    assert valid == [0, 1, 2, 3, 4]
    assert op.rejects(df).count() == len(BAD)
    # The windows of the node table agree with the row expression.
    assert [r["line_no"] for r in op.nodes(df).select("line_no").distinct().orderBy("line_no").collect()] == valid


def test_bracket_table(spark):
    found = op.bracket_table(table(spark, "(ROOT (S (N a) b (V (W w))))")).orderBy("node_no").collect()
    assert [(r["node_no"], r["level"], r["label"], r["parent_no"], r["child_no"]) for r in found] == [
        (0, 1, "ROOT", None, 1),
        (1, 2, "S", 0, 1),
        (2, 3, "N", 1, 1),
        (3, 3, "V", 1, 3),
        (4, 4, "W", 3, 1),
    ]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_edges_and_labels(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", broadcast_bytes)
    nodes = op.nodes(table(spark, CAT))
    edges = {(r["graph"], r["src"], r["dst"]) for r in op.edges(nodes).collect()}
    assert edges == {("enc", i, 0) for i in (1, 2, 3)} | {("dec", 0, i) for i in (1, 2, 3)}
    vocab = op.label_vocab(nodes)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    coded = op.encode_labels(nodes, vocab.filter("token <> 'S_3'")).orderBy("node_id").collect()
    assert [r["enc_x"] for r in coded] == [ids[x] for x in ("S_1", "NP_1", "VP_1", "._1")]
    assert [r["dec_x"] for r in coded] == [ids["ROOT_1"], ids["S_1"], ids["S_2"], 3]


def test_roll_up_and_pass_down(spark):
    nodes = op.nodes(table(spark, DEEP, CAT))
    sized = op.roll_up(
        nodes,
        own={"n": F.lit(1).cast("bigint")},
        gather={"n": F.sum},
        merge={"n": F.expr("n + coalesce(child_n, 0)")},
    )
    assert rows(sized, "line_no", "node_id", "n") == [
        (0, 0, 7), (0, 1, 5), (0, 2, 3), (0, 3, 1), (0, 4, 1), (0, 5, 1), (0, 6, 1),
        (1, 0, 4), (1, 1, 1), (1, 2, 1), (1, 3, 1),
    ]
    paths = op.pass_down(
        nodes, root={"path": F.col("y")}, step={"path": F.concat_ws("/", "parent_path", "y")}
    )
    assert rows(paths.filter("line_no = 0 and node_id = 4"), "path") == [("A_1/B_1/C_1/F_1",)]


def test_forest(spark):
    found = op.forest(op.nodes(table(spark, CAT, DEEP, CAT)), 2).orderBy("line_no", "node_id").collect()
    assert [r["batch_id"] for r in found] == [0] * 11 + [1] * 4
    assert [r["forest_id"] for r in found] == [*range(11), *range(4)]


def test_deep_trees_over_several_freezes(spark):
    depth = 2 * op.LEVELS_PER_FREEZE + 4
    cfg = "".join(f"(L{i} " for i in range(depth)) + "(X x) (Y y)" + ")" * depth
    nodes = op.nodes(table(spark, cfg))
    sized = op.roll_up(
        nodes, own={"n": F.lit(1).cast("bigint")}, gather={"n": F.sum}, merge={"n": F.expr("n + coalesce(child_n, 0)")}
    )
    assert rows(sized, "n") == [(depth - i,) for i in range(depth)]
    down = op.pass_down(nodes, root={"h": F.lit(0)}, step={"h": F.expr("parent_h + 1")})
    assert rows(down, "h") == [(i,) for i in range(depth)]


def test_lines_are_not_exploded_before_their_nodes_are_linked(spark):
    # Tokens as rows were sorted four times; that spilled three times the input and more.
    plan = op.nodes(table(spark, CAT))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan


def test_empty_lines_between_trees_and_lines_of_one_number(spark):
    df = spark.createDataFrame(
        [(0, ""), (1, DEEP), (2, None), (3, CAT), (4, "(A a"), (5, "(N (A a))"), (5, "(N (A a))")],
        "line_no bigint, cfg string",
    ).coalesce(1)
    found = op.bracket_table(df).groupBy("line_no").count().orderBy("line_no")
    # Of two equal lines of one number, read token by token, the inner N stands where its parent stands.
    assert [tuple(r) for r in found.collect()] == [(1, 9), (3, 8), (5, 3)]
    many = spark.range(3000).select(F.col("id").alias("line_no"), F.expr(f"if(id % 2 = 0, '{DEEP}', '{CAT}')").alias("cfg"))
    counts = op.nodes(many.coalesce(1)).groupBy("line_no").count()
    assert {tuple(r) for r in counts.selectExpr("line_no % 2", "count").distinct().collect()} == {(0, 7), (1, 4)}


def test_node_arrays_are_the_node_table(spark):
    odd = [CAT, DEEP, WIDE, "(A (B b", "", "(ROOT (X x))", "(A (B b) c)", None]
    trees = table(spark, *odd).union(table(spark, "(A (B b) (C c))").withColumn("line_no", F.lit(1).cast("bigint")))
    columns = ["line_no", "node_id", "parent_id", "depth", "pos", "mask", "enc_label", "dec_label", "y"]
    for depth_limit in (0, 2):
        arrays = op.node_arrays(trees, depth_limit)
        ids = [[n.node_id for n in r.nodes] for r in arrays.collect()]
        assert ids and all(i == sorted(set(i)) for i in ids)
        found = arrays.select("line_no", F.inline("nodes"))
        assert rows(found, *columns) == rows(op.nodes(trees, depth_limit), *columns)


def test_loader_rows_hold_no_nodes_as_rows(spark):
    sources = spark.createDataFrame([(0, "a b"), (1, "b")], "line_no bigint, src string")
    vocab = vocabulary.build_vocab(spark.createDataFrame([("a",), ("b",)], "token string"))
    found = loading.loader_rows(sources, table(spark, CAT, "(A"), vocab)
    assert [(r.line_no, len(r.nodes)) for r in found.collect()] == [(0, 4)]
    assert "inline" not in found._jdf.queryExecution().optimizedPlan().toString()
