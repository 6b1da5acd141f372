"""Every registered query against its DuckDB SQL, and the shape of key plans."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from bellwether.plans.oracle import ORACLE
from bellwether.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NO_SQL = {"cms_builtin", "predict_direction", "direction_accuracy"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    same, note = compare(spark, con, name, SF_DIR)
    assert same, note


def test_registry():
    assert set(QUERIES) - set(ORACLE) == NO_SQL
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_growth_scans_mentions_once_per_need(spark):
    plan = plan_of(entry.queries()["growth_score"](spark, SF_DIR))
    assert "ReusedExchange" in plan
    assert "CartesianProduct" not in plan and "Python" not in plan


@pytest.mark.parametrize(
    "name", sorted(set(QUERIES) - {"predict_direction", "direction_accuracy"})
)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert node not in plan


def test_ranks_are_limited_before_the_shuffle(spark):
    for name in ("top_headlines_per_company", "cap_per_source", "sma_latest", "latest_quote"):
        plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Partial" in plan[plan.index("WindowGroupLimit") :]


def test_date_range_reaches_the_scan(spark):
    plan = entry.queries()["price_range_scan"](spark, SF_DIR)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text and "GreaterThanOrEqual(l_shipdate" in text
