"""Every registered query against DuckDB, or for rows where SQL has no say."""

from __future__ import annotations

import os

import pytest

from stepfree import registry

DATA = os.environ.get("STEPFREE_TEST_DATA", "/root/testdata/sf0.001")
ORACLES = registry.all_oracles()


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_query(spark, same, name):
    df = registry.all_queries()[name](spark, DATA)
    if name in ORACLES:
        same(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_no_product_joins(spark):
    """Spatial joins run on cells, not as nested loops; the edge view alone puts four rows (k) beside each part."""
    for name in ("join_distance", "agg_hazard_risk", "agg_risk_score", "graph_snap"):
        plan = registry.all_queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        loops = [line for line in plan.splitlines() if "NestedLoop" in line]
        assert all("(k#" in line for line in loops) and "CartesianProduct" not in plan, name
        assert not loops or name == "agg_risk_score"
