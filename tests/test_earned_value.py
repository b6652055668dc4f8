"""Weekly facts: cutoff, sparse weeks, running values, signatures, scales and leak classes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobmargin.functions.dates import week_end_sunday
from jobmargin.plans import earned_value as ev
from jobmargin.plans import leaks
from tests.portfolio import by, portfolio

W1, W2, W5 = dt.date(2024, 1, 7), dt.date(2024, 1, 14), dt.date(2024, 2, 4)


@pytest.fixture(scope="module")
def tables(spark):
    return portfolio(spark)


@pytest.fixture(scope="module")
def fact(tables):
    return by(ev.burn_signatures(tables), "sov_line_id", "week_end")


@pytest.mark.parametrize("day, sunday", [
    ("2024-01-07", "2024-01-07"), ("2024-01-08", "2024-01-14"), ("2023-12-31", "2023-12-31"),
    ("2024-12-30", "2025-01-05")])
def test_week_end(spark, day, sunday):
    row = spark.range(1).select(week_end_sunday(F.to_date(F.lit(day))).alias("w")).first()
    assert row.w.isoformat() == sunday


def test_cutoff_drops_late_rows_and_projects_without_billing(tables):
    assert {r.log_id for r in ev.closeout_cutoff(tables, "labor_logs").collect()} == {
        "LOG-1", "LOG-2", "LOG-3", "LOG-5", "LOG-6"}
    assert {r.project_id for r in ev.labor_week(tables).collect()} == {"P1", "P2"}


def test_weekly_frame(fact):
    assert set(fact) == {("P1-1", W1), ("P1-1", W5), ("P1-2", W2), ("P2-1", W1), ("P2-1", W5), ("P2-2", W2),
                         ("P1-1", W2)}
    first = fact["P1-1", W1]
    assert (first["labor_cost_w"], first["labor_hours_w"], first["material_cost_w"]) == (450, 14, 90)
    assert (first["pct_complete"], first["scheduled_value"], first["description"]) == (0, 0, "")
    assert fact["P1-1", W5]["description"] == ""        # billed, but without a description
    assert fact["P1-2", W2]["pct_complete"] == 100      # clipped
    assert fact["P2-1", W5]["pct_complete"] == 0        # clipped


def test_running_values_and_signatures(fact):
    last = fact["P1-1", W5]
    assert (last["labor_cost_td"], last["pct_complete_td"], last["total_billed_td"]) == (450, 45, 270)
    assert last["budget_hours_adj"] == 20
    assert last["earned_labor_cost_td"] == 135
    assert last["labor_burn_mult_cost"] == pytest.approx(450 / 135)
    assert last["billing_lag_ratio"] == pytest.approx(540 / 270)
    assert fact["P1-1", W1]["labor_burn_mult_cost"] is None
    assert fact["P2-2", W2]["labor_burn_mult_cost"] is None and fact["P2-2", W2]["billing_lag_ratio"] is None
    assert fact["P2-2", W2]["budget_hours_adj"] == 0    # productivity 0 is not divided by


def test_spine_equals_fact_keys(tables, fact):
    spine = {(r.sov_line_id, r.week_end) for r in ev.week_spine(tables).collect()}
    assert spine == set(fact)


def test_closeout_and_scales(tables):
    rows = by(ev.scaled_variance(tables), "sov_line_id")
    assert rows["P1-1"]["week_end"] == W5 and rows["P1-2"]["week_end"] == W2
    assert rows["P1-1"]["labor_scale"] == pytest.approx((450 / 300 + 100 / 200) / 2)
    assert rows["P1-1"]["var_labor_scaled"] == pytest.approx(450 - 300)
    assert rows["P1-1"]["early_burn"] == pytest.approx(450 / 60)
    assert rows["P2-2"]["labor_cost_ratio"] is None and rows["P2-2"]["var_labor_scaled"] == pytest.approx(50)
    assert by(ev.project_scales(tables), "project_id")["P1"]["labor_scale"] == rows["P1-1"]["labor_scale"]


def test_scale_is_null_without_budgeted_lines(spark):
    tables = portfolio(spark, sov_budget=["P2-1,P2,0,0,0,0,0,1", "P2-2,P2,0,0,0,0,0,1"])
    rows = by(ev.scaled_variance(tables), "sov_line_id")
    assert rows["P2-1"]["labor_scale"] is None and rows["P2-1"]["var_total_scaled"] is None


def test_project_week_counts_active_lines_only(tables):
    active = by(ev.project_week(tables), "project_id", "week_end")
    dense = by(ev.project_week_dense(tables), "project_id", "week_end")
    assert active["P1", W5]["labor_cost_td"] == 450     # line 2 is not active that week
    assert dense["P1", W5]["labor_cost_td"] == 550
    assert set(active) == set(dense)
    costs = [dense["P1", w]["labor_cost_td"] for w in (W1, W2, W5)]
    assert costs == sorted(costs)


def test_closeout_summary_identity(tables):
    rows = by(leaks.project_closeout_summary(tables), "project_id")
    lines = [r for r in ev.scaled_variance(tables).collect() if r.project_id == "P1"]
    assert rows["P1"]["total_labor_var_scaled"] == pytest.approx(sum(r.var_labor_scaled for r in lines))
    assert rows["P1"]["num_sov_lines"] == 2 and rows["P1"]["scheduled_value"] == 1000


def test_leak_classes_cover_every_line(tables):
    lines = leaks.leak_lines(tables).collect()
    assert {r.sov_line_id for r in lines} == {"P1-1", "P1-2", "P2-1", "P2-2"}
    classes = {r.sov_line_id: r.archetype for r in lines}
    assert classes["P2-2"] == leaks.UNBUDGETED
    assert classes["P1-1"] == leaks.EARLY_DRIFT
    totals = leaks.leak_archetypes(tables).collect()
    assert sum(r.lines for r in totals) == 4
    assert leaks.top_leaks(tables, 1).first().sov_line_id == "P1-1"


def test_recurring_needs_several_projects(tables):
    assert leaks.cross_project_pattern(tables, 2).collect() == []
    assert {r.description for r in leaks.cross_project_pattern(tables, 1).collect()} >= {"Ductwork"}


def test_one_project_with_a_third_of_the_rows(spark):
    """Weekly sums of a heavy project equal plain arithmetic."""
    many = [f"LOG-{k},P1,2024-01-{1 + k % 28:02d},P1-1,1,0,10,1,1" for k in range(3000)]
    tables = portfolio(spark, labor_logs=many)
    rows = ev.labor_week(tables).collect()
    assert sum(r.labor_cost_w for r in rows) == 30000
    assert by(ev.fact_closeout(tables), "sov_line_id")["P1-1"]["labor_cost_td"] == 30000
