"""Portfolio overview, project table and project details."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.functions.text import shortened
from jobmargin.plans import ledger
from jobmargin.plans.latest import latest_billing

Tables = Mapping[str, DataFrame]

COST_PARTS = ("budget", "labor", "material", "billed")
SUMMARY_PARTS = (*COST_PARTS, "change_orders", "scope", "completion")
NAME_LIMIT = 15


def portfolio_overview(tables: Tables) -> DataFrame:
    """One row of portfolio totals, margins, unsubmitted scope and pending change orders.

    All inputs meet in a single global aggregate, combined map-side.  Only billing is
    grouped by project before, to find each project's latest amount.
    """
    parts = ("budget", "labor", "material", "change_orders", "scope")
    contracts = tables["contracts"].select(F.lit(1).alias("contract_rows"), "original_contract_value")
    billed = ledger.project_ledger(tables, ["billed"]).select("total_billed")
    totals = ledger.stack([contracts, billed, *ledger.part_rows(tables, parts)]).agg(
        F.count("contract_rows").alias("project_count"),
        F.sum("original_contract_value").alias("value"),
        F.sum("total_billed").alias("total_billed"),
        *ledger.part_aggregates(parts),
    )
    measures = ("value", "bid_cost", "total_billed", "actual_labor_cost", "actual_material_cost",
                "unsubmitted_cost", "pending_amount")
    totals = totals.withColumns({c: m.zero_if_null(c) for c in measures})
    value, billed, cost = F.col("value"), F.col("total_billed"), m.actual_cost()
    return totals.select(
        m.dbl("value").alias("total_contract_value"),
        m.dbl("bid_cost").alias("total_bid_cost"),
        m.bid_margin(value, F.col("bid_cost")).alias("bid_margin"),
        m.dbl(billed).alias("total_billed"),
        m.dbl("actual_labor_cost").alias("actual_labor_cost"),
        m.dbl("actual_material_cost").alias("actual_material_cost"),
        m.dbl(cost).alias("total_actual_cost"),
        m.realized_margin(billed, cost).alias("realized_margin"),
        m.dbl("unsubmitted_cost").alias("at_risk_amount"),
        "project_count",
        F.col("pending_count").cast("bigint").alias("pending_cos"),
        m.dbl("pending_amount").alias("pending_co_amount"),
    )


def at_risk_amount(tables: Tables) -> DataFrame:
    """Cost of scope items without a submitted change order, whoever is responsible."""
    return (
        tables["scope_creep_candidates"]
        .where(F.col("co_status") == "not_submitted")
        .agg(m.dbl(m.zero_if_null(F.sum(m.scope_cost()))).alias("at_risk_amount"))
    )


def pending_co_totals(tables: Tables) -> DataFrame:
    return (
        tables["change_orders"]
        .where(m.is_pending())
        .agg(
            F.count(F.lit(1)).alias("pending_cos"),
            m.dbl(m.zero_if_null(F.sum("amount"))).alias("pending_co_amount"),
        )
    )


def project_pct_complete(tables: Tables) -> DataFrame:
    """Plain average completion of the lines on each project's latest application."""
    rows = ledger.project_ledger(tables, ["completion"])
    return rows.select("project_id", _pct_complete().alias("pct_complete"))


def _pct_complete() -> Column:
    return F.when(F.col("pct_lines") > 0, m.dbl("pct_sum") / F.col("pct_lines"))


def _bid_margin_pct() -> Column:
    value = F.col("original_contract_value")
    return m.share_if_positive(value - m.zero_if_null("bid_cost"), value).alias("bid_margin_pct")


def _realized_margin_pct() -> Column:
    billed = m.zero_if_null("total_billed")
    return m.share_if_positive(billed - m.actual_cost(), billed).alias("realized_margin_pct")


def project_summaries(tables: Tables) -> DataFrame:
    """The project table: costs, margins, completion and counts per contract."""
    rows = ledger.with_contract(
        tables, ledger.project_ledger(tables, SUMMARY_PARTS),
        "project_name", "original_contract_value", "gc_name", "substantial_completion_date",
    )
    value = F.col("original_contract_value")
    bid, billed = m.zero_if_null("bid_cost"), m.zero_if_null("total_billed")
    return rows.select(
        "project_id",
        "project_name",
        m.dbl(value).alias("original_contract_value"),
        "gc_name",
        "substantial_completion_date",
        m.dbl(bid).alias("bid_cost"),
        _bid_margin_pct(),
        m.dbl(billed).alias("total_billed"),
        m.dbl(m.zero_if_null("actual_labor_cost")).alias("actual_labor_cost"),
        m.dbl(m.zero_if_null("actual_material_cost")).alias("actual_material_cost"),
        _realized_margin_pct(),
        F.coalesce(_pct_complete(), F.lit(0.0)).alias("pct_complete"),
        m.zero_if_null("approved_count").cast("bigint").alias("approved_cos"),
        m.zero_if_null("pending_count").cast("bigint").alias("pending_cos"),
        m.zero_if_null("scope_count").cast("bigint").alias("scope_creep_count"),
    ).orderBy("project_id")


def project_labor(tables: Tables, project_id: str | None = None) -> DataFrame:
    return ledger.project_ledger(tables, ["labor"], project_id).select(
        "project_id",
        m.dbl("actual_labor_cost").alias("actual_labor_cost"),
        m.dbl("actual_labor_hours").alias("total_hours"),
    )


def project_material(tables: Tables, project_id: str | None = None) -> DataFrame:
    return ledger.project_ledger(tables, ["material"], project_id).select(
        "project_id", m.dbl("actual_material_cost").alias("actual_material_cost")
    )


def project_budget(tables: Tables, project_id: str | None = None) -> DataFrame:
    return ledger.project_ledger(tables, ["budget"], project_id).select(
        "project_id",
        m.dbl("budget_labor_cost").alias("budgeted_labor_cost"),
        m.dbl("budget_material_cost").alias("budgeted_material_cost"),
        m.dbl("budget_equipment_cost").alias("budgeted_equipment_cost"),
        m.dbl("budget_sub_cost").alias("budgeted_sub_cost"),
        F.col("budget_labor_hours").cast("bigint").alias("budgeted_labor_hours"),
    )


def for_project(frame: DataFrame, project_id: str | None) -> DataFrame:
    """Equality filter on project; Spark pushes it to the scan."""
    return frame if project_id is None else frame.where(F.col("project_id") == project_id)


def project_filter(tables: Tables, project_id: str) -> DataFrame:
    """The contract of one project."""
    return for_project(tables["contracts"], project_id)


def project_details(tables: Tables, project_id: str | None = None) -> DataFrame:
    """Contract, latest billing, and actual beside budgeted labor and material, one row per project."""
    contract = for_project(tables["contracts"], project_id).select(
        "project_id", "project_name", "original_contract_value", "contract_date",
        "substantial_completion_date", "retention_pct", "payment_terms", "gc_name", "architect",
        "engineer_of_record",
    )
    billing = for_project(latest_billing(tables), project_id).select(
        "project_id", "application_number", "period_end", "period_total", "cumulative_billed",
        "retention_held", "net_payment_due", F.col("status").alias("billing_status"),
    )
    sums = ledger.project_ledger(tables, ["budget", "labor", "material"], project_id)
    rows = contract.join(sums, "project_id", "left").join(billing, "project_id", "left")
    return rows.select(
        "project_id", "project_name",
        m.dbl("original_contract_value").alias("original_contract_value"),
        "contract_date", "substantial_completion_date",
        m.dbl("retention_pct").alias("retention_pct"),
        "payment_terms", "gc_name", "architect", "engineer_of_record",
        F.col("application_number").cast("bigint").alias("application_number"),
        "period_end",
        m.dbl("period_total").alias("period_total"),
        m.dbl("cumulative_billed").alias("cumulative_billed"),
        m.dbl("retention_held").alias("retention_held"),
        m.dbl("net_payment_due").alias("net_payment_due"),
        "billing_status",
        m.dbl(m.zero_if_null("actual_labor_cost")).alias("labor_actual"),
        m.dbl(m.zero_if_null("budget_labor_cost")).alias("labor_budgeted"),
        m.dbl(m.zero_if_null("actual_labor_hours")).alias("hours_actual"),
        m.dbl(m.zero_if_null("budget_labor_hours")).alias("hours_budgeted"),
        m.dbl(m.zero_if_null("actual_material_cost")).alias("material_actual"),
        m.dbl(m.zero_if_null("budget_material_cost")).alias("material_budgeted"),
        m.dbl(m.zero_if_null("budget_equipment_cost")).alias("equipment_budget"),
        m.dbl(m.zero_if_null("budget_sub_cost")).alias("subcontractor_budget"),
    )


def project_details_cos(tables: Tables, project_id: str | None = None) -> DataFrame:
    """A project's change orders, newest first."""
    rows = for_project(tables["change_orders"], project_id)
    return rows.select(
        "project_id", "co_number", "description", m.dbl("amount").alias("amount"), "status",
        "reason_category", "date_submitted",
    ).orderBy("project_id", F.desc("date_submitted"), "co_number")


def project_details_scope(tables: Tables, project_id: str | None = None) -> DataFrame:
    """A project's scope items by change-order status and responsibility."""
    rows = for_project(tables["scope_creep_candidates"], project_id)
    return rows.select(
        "project_id", "scope_id", "description", "responsibility", "co_status",
        F.col("estimated_labor_hours").cast("bigint").alias("estimated_labor_hours"),
        m.dbl("estimated_material_cost").alias("estimated_material_cost"),
    ).orderBy("project_id", "co_status", "responsibility", "scope_id")


def project_details_lines(tables: Tables, project_id: str | None = None) -> DataFrame:
    """Lines of a project's latest application with the SOV description, by line number."""
    lines = for_project(ledger.latest_billing_lines(tables), project_id).select(
        "project_id", "sov_line_id", "pct_complete", "total_billed", "this_period"
    )
    sov = tables["sov"].select("sov_line_id", F.col("description").alias("sov_description"), "line_number")
    return lines.join(sov, "sov_line_id").select(
        "project_id", "sov_line_id", "sov_description",
        F.col("line_number").cast("bigint").alias("line_number"),
        m.dbl("pct_complete").alias("pct_complete"),
        m.dbl("total_billed").alias("total_billed"),
        m.dbl("this_period").alias("this_period"),
    ).orderBy("project_id", "line_number", "sov_line_id")


def _summary_margins(tables: Tables) -> DataFrame:
    """The margins of the project table, from cost and billing alone."""
    rows = ledger.with_contract(
        tables, ledger.project_ledger(tables, COST_PARTS), "project_name", "original_contract_value"
    )
    return rows.select("project_id", "project_name", _bid_margin_pct(), _realized_margin_pct())


def margin_bands(tables: Tables) -> DataFrame:
    """Traffic-light band of each project's bid and realized margin."""
    return _summary_margins(tables).select(
        "project_id",
        m.margin_band("bid_margin_pct").alias("bid_band"),
        m.margin_band("realized_margin_pct").alias("realized_band"),
    )


def margin_chart_data(tables: Tables) -> DataFrame:
    """Shortened project name with both margins in percent, one decimal."""
    return _summary_margins(tables).select(
        "project_id",
        shortened("project_name", NAME_LIMIT).alias("name"),
        F.round(F.col("bid_margin_pct") * 100, 1).alias("bid_margin"),
        F.round(F.col("realized_margin_pct") * 100, 1).alias("realized_margin"),
    )
