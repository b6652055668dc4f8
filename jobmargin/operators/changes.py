"""Change-order pipeline and RFIs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.operators.portfolio import for_project
from jobmargin.plans import ledger

Tables = Mapping[str, DataFrame]


def _change_orders(tables: Tables, project_id: str | None) -> DataFrame:
    names = tables["contracts"].select("project_id", "project_name")
    return for_project(tables["change_orders"], project_id).join(names, "project_id")


def change_orders_list(tables: Tables, project_id: str | None = None) -> DataFrame:
    """Change orders with project name, newest first within a project."""
    return _change_orders(tables, project_id).select(
        "co_number", "project_id", "project_name", "description", m.dbl("amount").alias("amount"),
        "status", F.col("reason_category").alias("reason"), "date_submitted",
    ).orderBy("project_id", F.desc("date_submitted"), "co_number")


def co_status_summary(tables: Tables, project_id: str | None = None) -> DataFrame:
    """Count and amount of approved, pending (also under review) and rejected change orders."""
    status = F.col("status")
    groups = {"approved": status == "Approved", "pending": m.is_pending(), "rejected": status == "Rejected"}
    columns = [F.count(F.lit(1)).alias("total")]
    for name, member in groups.items():
        columns.append(F.count_if(member).alias(f"{name}_count"))
        amount = F.sum(F.when(member, F.col("amount")))
        columns.append(m.dbl(m.zero_if_null(amount)).alias(f"{name}_amount"))
    return _change_orders(tables, project_id).agg(*columns)


def co_reason_summary(tables: Tables, project_id: str | None = None) -> DataFrame:
    """Count and amount per reason; a missing or empty reason reads 'Unknown'."""
    reason = F.coalesce(F.nullif(F.col("reason_category"), F.lit("")), F.lit("Unknown"))
    return (
        _change_orders(tables, project_id)
        .groupBy(reason.alias("reason"))
        .agg(F.count(F.lit(1)).alias("co_count"), m.dbl(F.sum("amount")).alias("total_amount"))
    )


def co_summary_by_project(tables: Tables) -> DataFrame:
    """Counts and amounts per project; projects without change orders show zeros."""
    rows = ledger.with_contract(
        tables, ledger.project_ledger(tables, ["change_orders"]), "project_name"
    )
    counts = ("total_cos", "approved_count", "pending_count", "rejected_count")
    amounts = ("approved_amount", "pending_amount")
    return rows.select(
        "project_id", "project_name",
        *[m.zero_if_null(c).cast("bigint").alias(c) for c in counts],
        *[m.dbl(m.zero_if_null(c)).alias(c) for c in amounts],
    ).orderBy("project_id")


def co_additions_credits(tables: Tables) -> DataFrame:
    """Approved change orders per project: count, additions and credits."""
    amount = F.col("amount")
    return (
        tables["change_orders"]
        .where(F.col("status") == "Approved")
        .groupBy("project_id")
        .agg(
            F.count(F.lit(1)).alias("co_count"),
            m.dbl(F.sum(F.when(amount > 0, amount).otherwise(F.lit(0)))).alias("additions"),
            m.dbl(F.sum(F.when(amount < 0, amount).otherwise(F.lit(0)))).alias("credits"),
        )
    )


def rfi_response_days(tables: Tables) -> DataFrame:
    """Average days from submission to response per assignee, answered RFIs only."""
    days = F.datediff("date_responded", "date_submitted")
    return (
        tables["rfis"]
        .where(F.col("date_responded").isNotNull())
        .groupBy("assigned_to")
        .agg(F.avg(days).alias("avg_days"))
    )


def rfi_cost_exposure(tables: Tables) -> DataFrame:
    """Unclosed RFIs with a cost impact, per project and priority."""
    return (
        tables["rfis"]
        .where(F.col("cost_impact") & (F.col("status") != "Closed"))
        .groupBy("project_id", "priority")
        .agg(F.count(F.lit(1)).alias("open_rfis"), F.min("date_required").alias("earliest_required"))
    )


def co_with_rfi(tables: Tables) -> DataFrame:
    """Change orders with the RFI they refer to, where there is one."""
    rfis = tables["rfis"].select(
        "project_id", F.col("rfi_number").alias("related_rfi"), F.col("status").alias("rfi_status"),
        F.col("priority").alias("rfi_priority"), F.col("cost_impact").alias("rfi_cost_impact"),
    )
    return tables["change_orders"].join(rfis, ["project_id", "related_rfi"], "left").select(
        "project_id", "co_number", "status", m.dbl("amount").alias("amount"), "related_rfi",
        "rfi_status", "rfi_priority", "rfi_cost_impact",
    )
