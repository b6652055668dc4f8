"""Plans stay distributed: no Python, no cartesian products, few exchanges, pruned scans."""

import pytest

from jobmargin.catalog import QUERIES
from jobmargin.functions.text import contains_pattern
from jobmargin.plans import earned_value as ev
from jobmargin.plans import ledger
from tests.portfolio import portfolio

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "portfolio_overview", "project_summaries", "margin_by_sov_line", "risk_alerts", "scaled_variance",
    "project_week", "co_with_rfi", "field_notes_token_search"])
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas"):
        assert bad not in text


def test_project_ledger_has_one_exchange(spark):
    tables = portfolio(spark)
    text = plan(ledger.project_ledger(tables, ["budget", "labor", "material", "billed", "change_orders", "scope"]))
    assert text.count("Exchange ") == 1


def test_weekly_chain_is_partitioned_by_project_once(spark):
    tables = portfolio(spark)
    text = plan(ev.fact_line_week_td(tables))
    assert text.count("Exchange hashpartitioning(project_id#") >= 1
    above = text[:text.index("Exchange ")]
    assert above.count("Window") >= 2 and "SortAggregate" in above   # all above the one exchange by project


def test_scan_reads_needed_columns_only(spark):
    text = plan(QUERIES["project_labor"](spark, FOLDER))
    schema = text[text.index("ReadSchema"):]
    assert "l_extendedprice" not in schema and "l_orderkey" not in schema
    names = plan(QUERIES["scope_items"](spark, FOLDER))
    assert "l_extendedprice" not in names            # the contract value is not computed for a name
