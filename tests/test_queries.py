"""Every registered query: against its SQL twin on the smallest tables, or at least non-empty."""

from __future__ import annotations

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


def no_all_pairs(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    no_all_pairs(df)
    if name in SQL:
        assert oracle.differences(df, SQL[name], duck) == []
    else:
        df.collect()
    no_all_pairs(df)  # the plan as it ran


def test_entry(spark):
    assert entry.entry(spark).count() > 0
