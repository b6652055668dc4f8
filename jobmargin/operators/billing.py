"""Cost not yet billed, by project and SOV line."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.operators.portfolio import for_project
from jobmargin.plans import earned_value as ev
from jobmargin.plans import ledger
from jobmargin.plans.intervals import as_of_join

Tables = Mapping[str, DataFrame]


def _lag_columns():
    billed, cost = m.zero_if_null("total_billed"), m.actual_cost()
    return [
        m.dbl(cost).alias("actual_cost"),
        m.dbl(billed).alias("billed"),
        m.dbl(m.billing_lag(cost, billed)).alias("lag"),
        m.billing_lag_pct(cost, billed).alias("lag_pct"),
    ]


def billing_lag_by_project(tables: Tables) -> DataFrame:
    rows = ledger.with_contract(
        tables, ledger.project_ledger(tables, ["labor", "material", "billed"]), "project_name"
    )
    return rows.select("project_id", "project_name", *_lag_columns()).orderBy("project_id")


def _line_lag(tables: Tables, project_id: str | None) -> DataFrame:
    sov = for_project(tables["sov"], project_id).select(
        "project_id", "sov_line_id", "line_number", "description"
    )
    facts = for_project(ledger.line_ledger(tables, ["labor", "material", "billed"]), project_id)
    return sov.join(facts, ["project_id", "sov_line_id"], "left")


def billing_lag_by_sov_line(tables: Tables, project_id: str | None = None) -> DataFrame:
    """Lag of every SOV line; a line missing from the project's latest application has billed 0."""
    return _line_lag(tables, project_id).select(
        "project_id",
        "sov_line_id",
        F.col("line_number").cast("bigint").alias("line_number"),
        "description",
        m.dbl(m.zero_if_null("actual_labor_cost")).alias("actual_labor_cost"),
        m.dbl(m.zero_if_null("actual_material_cost")).alias("actual_material_cost"),
        *_lag_columns(),
    ).orderBy("project_id", "line_number", "sov_line_id")


def billing_lag_total(tables: Tables, project_id: str | None = None) -> DataFrame:
    """Line lags summed per project, negative ones included."""
    lag = m.billing_lag(m.actual_cost(), m.zero_if_null("total_billed"))
    return (
        _line_lag(tables, project_id)
        .groupBy("project_id")
        .agg(m.dbl(F.sum(lag)).alias("total_billing_lag"))
    )


def labor_week_billing(tables: Tables) -> DataFrame:
    """Each week's labor of a line with the line's pay application in force at its end.

    `unbilled` is the labor cost to date less what that application had billed.  Weeks before the line's first
    application have none; applications without a billing period never come into force.
    """
    running = Window.partitionBy(*ev.LINE).orderBy("week_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weeks = ev.labor_week_uncut(tables).select(*ev.LINE_WEEK, "labor_hours_w", "labor_cost_w")
    periods = tables["billing_history"].select("project_id", "application_number", "period_end")
    billed = tables["billing_line_items"].select(*ev.LINE, "application_number", "pct_complete", "total_billed")
    applications = billed.join(periods, ["project_id", "application_number"])
    met = as_of_join(weeks, applications, ev.LINE, "week_end", "period_end", "application_number")
    to_date = met.withColumn("labor_cost_td", F.sum("labor_cost_w").over(running))
    return to_date.select(
        *ev.LINE_WEEK, m.dbl("labor_hours_w").alias("labor_hours_w"), m.dbl("labor_cost_w").alias("labor_cost_w"),
        m.dbl("labor_cost_td").alias("labor_cost_td"), F.col("application_number").cast("bigint").alias("application_number"),
        "period_end", F.date_diff("week_end", "period_end").cast("bigint").alias("days_since"),
        m.dbl("pct_complete").alias("pct_complete"), m.dbl("total_billed").alias("total_billed"),
        m.dbl(F.col("labor_cost_td") - m.zero_if_null("total_billed")).alias("unbilled"),
    )
