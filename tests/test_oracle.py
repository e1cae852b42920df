"""Every query with checking SQL gives the same rows as DuckDB on the small tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

from feathergrid.plans import catalog


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert difference(got, duck.execute(catalog.ORACLES[name]).fetchdf()) is None


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_no_query_plans_a_cartesian_product(spark, sf_dir):
    """A cross join would appear as CartesianProduct or an inner nested-loop join."""
    slow = {n for n in catalog.QUERIES if n.startswith("m") or n.startswith(("g6", "g7", "g8", "s", "d", "b"))}
    for name in sorted(set(catalog.QUERIES) - slow):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
