"""Every registered query: its plan, and its rows against the reference SQL."""

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry
from catalog.oracle import ORACLE
from catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON = {"generate_text", "generate_chapters", "outline_events", "chapter_batch_events"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan_and_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "InPandas" not in plan and "EvalPython" not in plan
    problem = compare(con, name, df)
    assert problem is None, problem


def test_every_query_has_reference_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["id", "title"] and df.count() > 0
