"""Every registered query against its checking SQL on the small tables."""

from __future__ import annotations

import pytest

from custodia.plans.catalog import CHECKS, QUERIES
from tests.check import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


#: Which lines of two texts match is the one thing that Python decides.
WITH_PYTHON = {"ordered_diff"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", *([] if name in WITH_PYTHON else ["EvalPython"])):
        assert unwanted not in plan
    if name in CHECKS:
        assert compare(df, con, CHECKS[name]) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
