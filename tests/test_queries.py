"""Every registered query: rows equal to its SQL, and a plan that scales."""

import os
import re

import pytest

from oracle_check import compare, connect
from weft import plans

SF_DIR = os.environ.get("WEFT_TEST_SF", "/root/testdata/sf0.001")
# Learning merges runs one job per round; the plan is the easy part.
SLOW_PLANS = {"bpe_apply", "corpus_prep"}


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(plans.queries()))
def test_rows_equal_sql(spark, oracle, name):
    assert compare(spark, oracle, name, SF_DIR) == ""


@pytest.mark.parametrize("name", [n for n in plans.queries() if n not in SLOW_PLANS])
def test_plan(spark, name):
    plan = plans.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        node = line.strip(" :+-*()0123456789")
        if node.startswith("Window ["):
            # Window [functions], [partition], [order]: the partition must not be empty.
            assert re.search(r"\], \[[^\]]+\]", node), line


def test_every_oracle_belongs_to_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"bpe_learn", "bpe_apply", "corpus_prep"}
