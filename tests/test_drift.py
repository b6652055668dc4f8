"""Rolling burn and change points against a plain recursion."""

import datetime as dt
from decimal import Decimal

import pytest

from jobmargin.catalog import QUERIES
from jobmargin.plans import drift
from jobmargin.plans import earned_value as ev
from tests.portfolio import by, portfolio


def cusum(weeks, budget, slack):
    """(excess, since) week by week: restart at zero."""
    out, excess, since = [], Decimal(0), None
    for week, cost, earned in weeks:
        excess = max(Decimal(0), excess + cost - earned - budget * slack)
        since = None if excess == 0 else since or week
        out.append((excess, since))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    """One line over 40 weeks with quiet and costly spells, gaps and billing in steps; budget 300."""
    start = dt.date(2024, 1, 3)
    hours = [1, 0, 2, 9, 1, 1, 0, 0, 12, 1, 1, 1, 20, 3, 1, 1, 0, 0, 0, 0, 1, 2, 1, 1, 9, 0, 0, 1, 1, 1]
    labor = [f"L{k},P1,{start + dt.timedelta(days=7 * k)},P1-1,{h},0,4,1,1" for k, h in enumerate(hours) if h]
    ends = [start + dt.timedelta(days=7 * k + 2) for k in (2, 7, 14, 20, 26, 29)]
    billing = [f"P1,{n},{end},1,1" for n, end in enumerate(ends, 1)]
    lines = [f"P1-1,P1,{n},Duct,600,0,1,{n},{pct}" for n, pct in enumerate([30, 45, 70, 75, 100, 100], 1)]
    return portfolio(spark, labor_logs=labor, billing_history=billing, billing_line_items=lines, material_deliveries=["D1,P1,2024-01-03,P1-1,1,1"])


def test_excess_restarts_at_zero(tables):
    rows = sorted(drift.rolling_burn(tables).where("sov_line_id = 'P1-1'").collect(), key=lambda r: r.week_end)
    weeks = [(r.week_end, r.labor_cost_w, r.earned_w) for r in rows]
    expected = cusum(weeks, Decimal(300), Decimal("0.01"))
    assert [(r.excess, r.since) for r in rows] == expected
    assert sum(e == 0 for e, _ in expected) >= 2 and len({s for _, s in expected}) > 3
    for r in rows:
        recent = [(cost, earned) for week, cost, earned in weeks if r.week_end - dt.timedelta(days=27) <= week <= r.week_end]
        assert (r.cost_4w, r.earned_4w) == tuple(map(sum, zip(*recent)))
        assert r.burn_4w == (pytest.approx(float(r.cost_4w) / float(r.earned_4w)) if r.earned_4w else None)


def test_change_point_is_the_start_of_the_first_signal(tables):
    point = by(drift.burn_change_points(tables), "sov_line_id")["P1-1"]
    rows = sorted(drift.rolling_burn(tables).where("sov_line_id = 'P1-1'").collect(), key=lambda r: r.week_end)
    first = next(r for r in rows if r.excess > 30)
    assert (point["signal_week"], point["change_week"]) == (first.week_end, first.since)
    assert point["weeks_to_signal"] == (first.week_end - first.since).days // 7


def test_lines_without_budget_have_none(spark):
    rows = drift.rolling_burn(portfolio(spark)).collect()
    assert {r.sov_line_id for r in rows} == {"P1-1", "P1-2", "P2-1"}


def test_one_partitioning_by_line(spark):
    """The windows add no exchange to that of the running totals."""
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    tables = portfolio(spark)
    assert count(drift.rolling_burn(tables)) <= count(ev.earned_value(tables))
    assert "Python" not in QUERIES["burn_change_points"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
