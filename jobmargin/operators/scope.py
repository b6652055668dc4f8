"""Out-of-scope work: items, recoverable revenue and rework."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.functions.text import shortened
from jobmargin.operators.portfolio import for_project
from jobmargin.plans import ledger

Tables = Mapping[str, DataFrame]

DESCRIPTION_LIMIT = 200


def _items(tables: Tables, project_id: str | None, rate: Decimal) -> DataFrame:
    items = for_project(tables["scope_creep_candidates"], project_id)
    names = tables["contracts"].select("project_id", "project_name")
    return items.join(names, "project_id").withColumn("scope_cost", m.scope_cost(rate))


def scope_items(tables: Tables, project_id: str | None = None,
                rate: Decimal = m.SCOPE_LABOR_RATE) -> DataFrame:
    """Scope items with project name and estimated cost."""
    return _items(tables, project_id, rate).select(
        "scope_id", "project_id", "project_name", "description", "responsibility", "co_status",
        F.col("estimated_labor_hours").cast("bigint").alias("estimated_labor_hours"),
        m.dbl("estimated_material_cost").alias("estimated_material_cost"),
        m.dbl("scope_cost").alias("estimated_total_cost"),
    ).orderBy("project_id", "co_status", "responsibility", "scope_id")


def scope_summary(tables: Tables, project_id: str | None = None,
                  rate: Decimal = m.SCOPE_LABOR_RATE) -> DataFrame:
    """Counts and totals of recoverable, absorbed and pending items.

    The classes are not a partition: an item can be in several or in none.
    """
    classes = {
        "recoverable": m.is_recoverable(), "absorbed": m.is_absorbed(), "pending": m.is_scope_pending(),
    }
    columns = [F.count(F.lit(1)).alias("total_items")]
    for name, member in classes.items():
        columns.append(F.count_if(member).alias(f"{name}_count"))
        total = F.sum(F.when(member, F.col("scope_cost")))
        columns.append(m.dbl(m.zero_if_null(total)).alias(f"{name}_total"))
    return _items(tables, project_id, rate).agg(*columns)


def scope_unbilled_hours(tables: Tables) -> DataFrame:
    return (
        tables["scope_creep_candidates"]
        .where(F.col("co_status") == "not_submitted")
        .agg(F.sum("estimated_labor_hours").cast("bigint").alias("unbilled_hours"))
    )


def _filtered_items(tables: Tables, member) -> DataFrame:
    return tables["scope_creep_candidates"].where(member).select(
        "scope_id", "project_id", "responsibility", "co_status",
        F.col("estimated_labor_hours").cast("bigint").alias("estimated_labor_hours"),
        m.dbl("estimated_material_cost").alias("estimated_material_cost"),
        m.dbl(m.scope_cost()).alias("estimated_total_cost"),
    )


def scope_recoverable(tables: Tables) -> DataFrame:
    return _filtered_items(tables, m.is_recoverable())


def scope_absorbed(tables: Tables) -> DataFrame:
    """Items whose change-order status is absorbed (responsibility is not looked at here)."""
    return _filtered_items(tables, F.col("co_status") == "absorbed")


def scope_vs_change_orders(tables: Tables) -> DataFrame:
    """Recoverable scope beside the change-order pipeline of each project."""
    rows = ledger.project_ledger(tables, ["scope", "change_orders"])
    return rows.select(
        "project_id",
        F.col("recoverable_count").cast("bigint").alias("recoverable_count"),
        m.dbl(m.zero_if_null("recoverable_cost")).alias("recoverable_cost"),
        F.col("pending_count").cast("bigint").alias("pending_count"),
        m.dbl(m.zero_if_null("pending_amount")).alias("pending_amount"),
        F.col("approved_count").cast("bigint").alias("approved_count"),
        m.dbl(m.zero_if_null("approved_amount")).alias("approved_amount"),
    ).orderBy("project_id")


def _rework(tables: Tables) -> DataFrame:
    return tables["labor_logs"].where(m.is_rework()).select(
        "project_id",
        F.lit(1).alias("rework_rows"),
        m.labor_hours().alias("rework_hours"),
        m.labor_cost().alias("rework_cost"),
    )


def rework_labor(tables: Tables) -> DataFrame:
    """Overtime and rework entries per project: rows, hours and cost."""
    return _rework(tables).groupBy("project_id").agg(
        F.count("rework_rows").alias("entries"),
        m.dbl(F.sum("rework_hours")).alias("hours"),
        m.dbl(F.sum("rework_cost")).alias("cost"),
    )


def rework_vs_scope(tables: Tables) -> DataFrame:
    """Rework hours against the hours estimated for scope items; the ratio is NULL without an estimate."""
    scope = tables["scope_creep_candidates"].select(
        "project_id", F.col("estimated_labor_hours").alias("scope_hours")
    )
    sums = ledger.stack([_rework(tables).select("project_id", "rework_hours"), scope]).groupBy(
        "project_id"
    ).agg(
        m.zero_if_null(F.sum("rework_hours")).alias("rework_hours"),
        m.zero_if_null(F.sum("scope_hours")).alias("scope_hours"),
    )
    ratio = F.when(F.col("scope_hours") != 0, m.dbl("rework_hours") / m.dbl("scope_hours"))
    return sums.select(
        "project_id",
        m.dbl("rework_hours").alias("rework_hours"),
        F.col("scope_hours").cast("bigint").alias("scope_hours"),
        ratio.alias("rework_ratio"),
    )


def scope_description(tables: Tables, limit: int = DESCRIPTION_LIMIT) -> DataFrame:
    """The listing text of an item, cut from its full description."""
    return tables["scope_creep_candidates"].select(
        "scope_id", shortened("full_description", limit).alias("description")
    )
