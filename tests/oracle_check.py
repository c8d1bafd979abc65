"""Run queries and their SQL on the same tables and compare rows.

usage: python tests/oracle_check.py SF_DIR [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weft import plans  # noqa: E402
from weft.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    df = plans.queries()[name](spark, sf_dir)
    types = [f.dataType.simpleString() for f in df.schema.fields]
    ours_cols, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in plans.oracle_sql():
        return "" if ours else "no rows"
    cursor = con.execute(plans.oracle_sql()[name])
    described = [(d[0], str(d[1])) for d in cursor.description]
    theirs_cols, theirs = rows_of([d[0] for d in described], cursor.fetchall())
    if ours_cols != theirs_cols:
        return f"columns {ours_cols} != {theirs_cols}"
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
    theirs_types = dict(described)
    odd = [
        (c, t, theirs_types[c])
        for c, t in zip(df.columns, types)
        if names.get(t, theirs_types[c]) != theirs_types[c]
    ]
    if ours != theirs:
        left = [r for r in ours if r not in set(theirs)][:3]
        right = [r for r in theirs if r not in set(ours)][:3]
        return f"{len(ours)} rows != {len(theirs)} rows\n  ours   {str(left)[:900]}\n  theirs {str(right)[:900]}"
    if not ours:
        return "no rows on either side"
    return f"types differ: {odd}" if odd else ""


if __name__ == "__main__":
    sf_dir = sys.argv[1]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or plans.queries():
        began = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.1f}s {problem}", flush=True)
    print(f"{bad} failures")
