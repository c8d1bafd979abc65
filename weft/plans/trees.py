"""Bracket trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import normalise_brackets
from weft.operators import trees as op
from weft.plans import views
from weft.session import freeze
from weft.sources import tables

FOREST_BATCH = 128
DEPTH_LIMIT = 2


def cfg_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raw leaves: one-character leaves and leaves with a third field."""
    items = tables.table(spark, sf_dir, "lineitem")
    raw = F.concat(
        F.lit("(ITEM ("), "l_returnflag", F.lit(") (PART "), F.col("l_partkey").cast("string"), F.lit(" "), "l_linestatus", F.lit("))")
    )
    return items.select(normalise_brackets(raw).alias("cfg")).groupBy("cfg").agg(F.count(F.lit(1)).alias("n"))


def tree_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.bracket_table(tables.trees(spark, sf_dir))


def tree_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under way lose the last bracket of their tree."""
    status = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), "o_orderstatus")
    cut = F.expr("if(o_orderstatus = 'O', substr(cfg, 1, length(cfg) - 1), cfg)")
    damaged = tables.trees(spark, sf_dir).join(status, "line_no").select("line_no", cut.alias("cfg"))
    return damaged.select("line_no", op.is_valid("cfg").alias("valid"))


def _nodes(spark: SparkSession, sf_dir: str, depth_limit: int = 0) -> DataFrame:
    return op.nodes(tables.trees(spark, sf_dir), depth_limit)


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir)


def tree_nodes_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, 1)


def tree_nodes_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, DEPTH_LIMIT)


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.edges(_nodes(spark, sf_dir))


def tree_label_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.label_vocab(_nodes(spark, sf_dir))


def tree_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = freeze(_nodes(spark, sf_dir))
    return op.encode_labels(table, op.label_vocab(table)).select("line_no", "node_id", "enc_x", "dec_x", "y_id")


def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _nodes(spark, sf_dir)
    sized = op.roll_up(
        table,
        own={name: F.lit(value).cast("bigint") for name, value in (("n_nodes", 1), ("height", 0), ("n_leaves", 0))},
        gather={"n_nodes": F.sum, "height": F.max, "n_leaves": F.sum},
        merge={
            "n_nodes": F.expr("n_nodes + coalesce(child_n_nodes, 0)"),
            "height": F.expr("coalesce(child_height + 1, 0)"),
            "n_leaves": F.expr("coalesce(child_n_leaves, 1)"),
        },
    )
    return op.pass_down(
        sized,
        root={"path": F.col("enc_label")},
        step={"path": F.concat_ws("/", "parent_path", "enc_label")},
    ).select("line_no", "node_id", "n_nodes", "height", "n_leaves", "path")


def tree_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.forest(_nodes(spark, sf_dir), FOREST_BATCH).select("line_no", "node_id", "batch_id", "forest_id")


QUERIES = {
    "cfg_normalise": cfg_normalise,
    "tree_brackets": tree_brackets,
    "tree_valid": tree_valid,
    "tree_nodes": tree_nodes,
    "tree_nodes_depth1": tree_nodes_depth1,
    "tree_nodes_depth2": tree_nodes_depth2,
    "tree_edges": tree_edges,
    "tree_label_vocab": tree_label_vocab,
    "tree_encoded": tree_encoded,
    "tree_rollup": tree_rollup,
    "tree_forest": tree_forest,
}

# Nodes straight from the items, without any tree text. ORDER is the root: its wrapper is
# skipped. The items are inner nodes (depth 2) whose only child is a tag with a word, so
# their children are dropped; ITEMS keeps its children unless there are more than ten.
NODES = (
    views.ITEMS
    + """,
v_orders AS (SELECT DISTINCT line_no, status, n_items FROM v_items),
v_nodes AS (
  SELECT line_no, 0 AS node_id, NULL AS parent_id, 0 AS depth, 0 AS pos, 1 AS mask,
         'ORDER_1' AS enc_label, 'ROOT_1' AS dec_label, 'ORDER_1' AS y FROM v_orders
  UNION ALL SELECT line_no, 1, 0, 1, 0, 0, 'STATUS_1', 'ORDER_1', 'STATUS_1' FROM v_orders
  UNION ALL SELECT line_no, 2, 0, 1, 1, 0, 'ITEMS_1', 'ORDER_2', 'ITEMS_1' FROM v_orders
  UNION ALL SELECT line_no, CAST(k + 2 AS INTEGER), 2, 2, CAST(k - 1 AS INTEGER), 0, flag || '_1', 'ITEMS_' || k, flag || '_1'
  FROM v_items WHERE n_items <= 10 AND {deeper}
)"""
)
# An item has one child, and that is a tag with a word: ITEMS has children that start with
# a node, so all of them are kept.
FULL = NODES.replace("{deeper}", "TRUE")
SHALLOW = NODES.replace("{deeper}", "FALSE")

_VOCAB = f"""{FULL},
labels2 AS (SELECT enc_label AS token FROM v_nodes UNION ALL SELECT dec_label FROM v_nodes),
v_vocab AS (
  SELECT 0 AS id, '<null>' AS token, 0 AS cnt UNION ALL SELECT 1, '<s>', 0
  UNION ALL SELECT 2, '</s>', 0 UNION ALL SELECT 3, 'UNK', 0 UNION ALL
  SELECT row_number() OVER (ORDER BY count(*) DESC, token) + 3, token, count(*) FROM labels2 GROUP BY token
)"""

ORACLE = {
    "cfg_normalise": """
SELECT '(ITEM (' || l_returnflag || ' ' || l_returnflag || ') (PART ' || l_partkey || '))' AS cfg, count(*) AS n
FROM lineitem GROUP BY 1""",
    "tree_brackets": f"""
WITH {views.ITEMS}, o AS (SELECT DISTINCT line_no FROM v_items),
every AS (
  SELECT line_no, 0 AS node_no, 1 AS level, 'ROOT' AS label, NULL AS parent_no, 1 AS child_no FROM o
  UNION ALL SELECT line_no, 1, 2, 'ORDER', 0, 1 FROM o
  UNION ALL SELECT line_no, 2, 3, 'STATUS', 1, 1 FROM o
  UNION ALL SELECT line_no, 3, 3, 'ITEMS', 1, 2 FROM o
  UNION ALL SELECT line_no, 2 * k + 2, 4, flag, 3, k FROM v_items
  UNION ALL SELECT line_no, 2 * k + 3, 5, 'PART', 2 * k + 2, 1 FROM v_items)
SELECT line_no, CAST(node_no AS INTEGER) AS node_no, CAST(level AS BIGINT) AS level, label,
       CAST(parent_no AS INTEGER) AS parent_no, CAST(child_no AS INTEGER) AS child_no FROM every""",
    "tree_valid": """
SELECT o_orderkey AS line_no, o_orderstatus <> 'O' AS valid FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
    "tree_nodes": f"WITH {FULL} SELECT * FROM v_nodes",
    "tree_nodes_depth1": f"WITH {SHALLOW} SELECT * FROM v_nodes",
    # The items are at depth 2, so this limit keeps all nodes that the other rules keep.
    "tree_nodes_depth2": f"WITH {FULL} SELECT * FROM v_nodes",
    "tree_edges": f"""
WITH {FULL}
SELECT line_no, 'enc' AS graph, node_id AS src, parent_id AS dst FROM v_nodes WHERE parent_id IS NOT NULL
UNION ALL SELECT line_no, 'dec', parent_id, node_id FROM v_nodes WHERE parent_id IS NOT NULL""",
    "tree_label_vocab": f"WITH {_VOCAB} SELECT * FROM v_vocab",
    "tree_encoded": f"""
WITH {_VOCAB}
SELECT line_no, node_id, e.id AS enc_x, d.id AS dec_x, e.id AS y_id
FROM v_nodes n JOIN v_vocab e ON e.token = n.enc_label JOIN v_vocab d ON d.token = n.dec_label""",
    "tree_rollup": f"""
WITH {FULL},
kids AS (SELECT line_no, count(*) AS n FROM v_nodes WHERE depth = 2 GROUP BY line_no)
SELECT v.line_no, v.node_id,
       CASE v.node_id WHEN 0 THEN coalesce(n, 0) + 3 WHEN 2 THEN coalesce(n, 0) + 1 ELSE 1 END AS n_nodes,
       CAST(CASE v.node_id WHEN 0 THEN CASE WHEN n IS NULL THEN 1 ELSE 2 END
                           WHEN 2 THEN CASE WHEN n IS NULL THEN 0 ELSE 1 END ELSE 0 END AS BIGINT) AS height,
       CASE v.node_id WHEN 0 THEN coalesce(n, 1) + 1 WHEN 2 THEN coalesce(n, 1) ELSE 1 END AS n_leaves,
       CASE depth WHEN 0 THEN enc_label WHEN 1 THEN 'ORDER_1/' || enc_label
                  ELSE 'ORDER_1/ITEMS_1/' || enc_label END AS path
FROM v_nodes v LEFT JOIN kids k ON k.line_no = v.line_no""",
    "tree_forest": f"""
WITH {FULL},
placed AS (SELECT line_no, (row_number() OVER (ORDER BY line_no) - 1) // {FOREST_BATCH} AS batch_id
           FROM (SELECT DISTINCT line_no FROM v_nodes))
SELECT line_no, node_id, batch_id,
       row_number() OVER (PARTITION BY batch_id ORDER BY line_no, node_id) - 1 AS forest_id
FROM v_nodes JOIN placed USING (line_no)""",
}
