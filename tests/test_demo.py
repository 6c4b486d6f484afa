"""Every demo query against its DuckDB statement, and what the plans must not contain."""

import os
import re

import pytest
from oracle import connect, difference

import __spark_entry__ as entry
from demo import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


# Plans are made of Spark's own expressions and of joins on keys.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert difference(df, con, ORACLES[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    if name == "q22_not_in_literal":  # the shape as it is written; q22_not_in_large is the way for large subqueries
        return
    assert not re.search(r"LeftAnti, BuildRight, true", plan)  # the null-aware anti join broadcasts whatever the size


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
