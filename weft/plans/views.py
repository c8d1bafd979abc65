"""The views of ``weft.sources.tables`` as SQL, for the oracle queries."""

LINES = """
v_lines AS (
  SELECT doc_id, lang, source, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)
)"""

NUMBERED = """
v_numbered AS (
  SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS line_no, * FROM (
    SELECT doc_id, lang, source, unnest(range(0, len(parts))) AS pos, unnest(parts) AS line
    FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents)))"""

PAIRS = """
v_pairs AS (
  SELECT u.conv_id, u.turn, replace(u.text, chr(10), ' ') AS src, replace(a.text, chr(10), ' ') AS tgt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""

NBEST = NUMBERED + """,
v_raw AS (
  SELECT line_no AS rank, string_split(d.source || '|||' ||
           CASE WHEN l.doc_id IS NOT NULL THEN d.lang || '<eoc>' ELSE '' END || line
           || '|||' || 'length=' || length(line) || '|||' || line_no, '|||') AS f
  FROM v_numbered d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
v_nbest AS (
  SELECT f[1] AS block, rank,
         CASE WHEN len(string_split(f[2], '<eoc>')) = 2 THEN split_part(f[2], '<eoc>', 1) END AS code,
         CASE WHEN len(string_split(f[2], '<eoc>')) = 2
              THEN regexp_replace(split_part(f[2], '<eoc>', 2), '</s>$', '') ELSE f[2] END AS sent,
         f[3] AS p1, f[4] AS p2
  FROM v_raw
)"""

TRIPLES = NUMBERED + """,
v_triples AS (SELECT line_no // 3 AS block, line_no % 3 AS pos, line AS text FROM v_numbered)"""

# Affine scores of whole vectors against the mean vector of each label.
SCORES = """
v_x AS (SELECT vec_id, label, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
v_w AS (SELECT label, pos, sum(x) / (count(*) + 1e-7) AS w FROM v_x GROUP BY label, pos),
v_bits AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS bit FROM (SELECT DISTINCT label FROM v_w)),
v_scores AS (
  SELECT vec_id, bit, sum(x * w) + 0.25 AS s FROM v_x JOIN v_w USING (pos) JOIN v_bits ON v_bits.label = v_w.label GROUP BY ALL),
v_codes AS (
  SELECT vec_id, CAST(sum(CASE WHEN s > 0 THEN 1 << bit ELSE 0 END) AS BIGINT) AS code,
         row_number() OVER (ORDER BY vec_id) - 1 AS vec_no FROM v_scores GROUP BY vec_id)"""

# Items of the tree orders with their place; trees are made from these, so no parsing here.
ITEMS = """
v_items AS (
  SELECT l_orderkey AS line_no, o_orderstatus AS status, l_returnflag AS flag, l_partkey AS part,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_returnflag) AS k,
         count(*) OVER (PARTITION BY l_orderkey) AS n_items
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
)"""


TREES = ITEMS + """,
v_trees AS (
  SELECT row_number() OVER (ORDER BY line_no) - 1 AS tree_no,
         '(ROOT (ORDER (STATUS ' || any_value(status) || ') (ITEMS ' ||
         string_agg('(' || flag || ' (PART ' || part || '))', ' ' ORDER BY k) || ')))' AS cfg
  FROM v_items GROUP BY line_no)"""

# Lines with a tree and the code of a vector, both taken in turn.
LABELLING = f"""{NUMBERED}, {TREES}, {SCORES},
v_labelling AS (
  SELECT line_no, line AS src, cfg, CAST(code AS VARCHAR) AS code FROM v_numbered
  JOIN v_trees ON tree_no = line_no % (SELECT count(*) FROM v_trees)
  JOIN v_codes ON vec_no = line_no % (SELECT count(*) FROM v_codes))"""


def tokens(column: str) -> str:
    """White-space tokens of a column."""
    return f"list_filter(string_split_regex({column}, '\\s+'), lambda x: x <> '')"
