"""One-pass roll-ups of several fact tables.

A project or line report needs sums from budget, labor, material, billing, change
orders and scope.  Joining one aggregate per table costs an exchange per table.
Instead the tables are projected to (keys, measures), stacked with ``unionByName``
and aggregated once: rows are combined map-side before the single exchange, which
also takes the weight out of very large projects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmargin.functions import measures as m

Tables = Mapping[str, DataFrame]


def _budget(tables: Tables) -> DataFrame:
    return tables["sov_budget"].select(
        "project_id", "sov_line_id",
        m.bid_cost().alias("bid_cost"),
        F.col("estimated_labor_hours").alias("budget_labor_hours"),
        F.col("estimated_labor_cost").alias("budget_labor_cost"),
        F.col("estimated_material_cost").alias("budget_material_cost"),
        F.col("estimated_equipment_cost").alias("budget_equipment_cost"),
        F.col("estimated_sub_cost").alias("budget_sub_cost"),
    )


def _labor(tables: Tables) -> DataFrame:
    return tables["labor_logs"].select(
        "project_id", "sov_line_id",
        m.labor_cost().alias("actual_labor_cost"),
        m.labor_hours().alias("actual_labor_hours"),
    )


def _material(tables: Tables) -> DataFrame:
    return tables["material_deliveries"].select(
        "project_id", "sov_line_id", F.col("total_cost").alias("actual_material_cost")
    )


def _billed(tables: Tables) -> DataFrame:
    return tables["billing_history"].select("project_id", "application_number", "cumulative_billed")


def _completion(tables: Tables) -> DataFrame:
    # Summed per application, so the latest one can be picked without a self-join.
    return tables["billing_line_items"].groupBy("project_id", "application_number").agg(
        F.sum("pct_complete").alias("pct_sum"), F.count("pct_complete").alias("pct_lines")
    ).withColumnRenamed("application_number", "pct_application")


def _line_billing(tables: Tables) -> DataFrame:
    return tables["billing_line_items"].select(
        "project_id", "sov_line_id", "application_number", "total_billed"
    )


def _change_orders(tables: Tables) -> DataFrame:
    return tables["change_orders"].select(
        "project_id",
        F.lit(1).alias("co_rows"),
        F.col("status").alias("co_pipeline_status"),
        F.col("amount").alias("co_amount"),
    )


def _scope(tables: Tables, rate: Decimal = m.SCOPE_LABOR_RATE) -> DataFrame:
    return tables["scope_creep_candidates"].select(
        "project_id",
        F.lit(1).alias("scope_rows"),
        m.scope_cost(rate).alias("scope_cost"),
        F.col("estimated_labor_hours").alias("scope_hours"),
        m.is_recoverable().alias("scope_recoverable"),
        (F.col("co_status") == "not_submitted").alias("scope_not_submitted"),
    )


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def _co_status_aggregates() -> list[Column]:
    status = F.col("co_pipeline_status")
    groups = {
        "approved": status == "Approved",
        "pending": m.is_pending(status),
        "rejected": status == "Rejected",
    }
    out = [F.count("co_rows").alias("total_cos")]
    for name, member in groups.items():
        out.append(F.count_if(member).alias(f"{name}_count"))
        out.append(F.sum(F.when(member, F.col("co_amount"))).alias(f"{name}_amount"))
    return out


# part -> (projection, aggregates)
PARTS: dict[str, tuple[Callable[..., DataFrame], Callable[[], list[Column]]]] = {
    "budget": (_budget, lambda: _sums(
        "bid_cost", "budget_labor_hours", "budget_labor_cost", "budget_material_cost",
        "budget_equipment_cost", "budget_sub_cost")),
    "labor": (_labor, lambda: _sums("actual_labor_cost", "actual_labor_hours")),
    "material": (_material, lambda: _sums("actual_material_cost")),
    "billed": (_billed, lambda: [
        F.max_by("cumulative_billed", "application_number").alias("total_billed")]),
    "completion": (_completion, lambda: [
        F.max_by(c, "pct_application").alias(c) for c in ("pct_sum", "pct_lines")]),
    "change_orders": (_change_orders, _co_status_aggregates),
    "scope": (_scope, lambda: [
        F.count("scope_rows").alias("scope_count"),
        F.sum("scope_hours").alias("scope_hours"),
        F.count_if("scope_recoverable").alias("recoverable_count"),
        F.sum(F.when(F.col("scope_recoverable"), F.col("scope_cost"))).alias("recoverable_cost"),
        F.sum(F.when(F.col("scope_not_submitted"), F.col("scope_cost"))).alias("unsubmitted_cost"),
    ]),
}


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def part_rows(tables: Tables, parts: Iterable[str]) -> list[DataFrame]:
    return [PARTS[p][0](tables) for p in parts]


def part_aggregates(parts: Iterable[str]) -> list[Column]:
    return [aggregate for p in parts for aggregate in PARTS[p][1]()]


def project_ledger(tables: Tables, parts: Iterable[str], project_id: str | None = None) -> DataFrame:
    """One row per project with the measures of the named parts; NULL where a part has no row."""
    parts = list(parts)
    stacked = stack(rows.drop("sov_line_id") for rows in part_rows(tables, parts))
    if project_id is not None:
        stacked = stacked.where(F.col("project_id") == project_id)
    return stacked.groupBy("project_id").agg(*part_aggregates(parts))


def with_contract(tables: Tables, ledger: DataFrame, *columns: str) -> DataFrame:
    """Every contract with its ledger row; contracts without one get NULL measures."""
    contracts = tables["contracts"].select("project_id", *columns)
    return contracts.join(ledger, "project_id", "left")


def latest_application(tables: Tables) -> DataFrame:
    """The highest application number per project in the billing lines."""
    return tables["billing_line_items"].groupBy("project_id").agg(
        F.max("application_number").alias("application_number")
    )


def latest_billing_lines(tables: Tables) -> DataFrame:
    """Billing lines of each project's (not each line's) latest application.

    The grouped maximum is one small row per project, so Spark can broadcast it and
    leave the line table unshuffled; beyond that size the join key spreads a large
    project and AQE splits what is still skewed.
    """
    return tables["billing_line_items"].join(
        latest_application(tables), ["project_id", "application_number"]
    )


def line_ledger(tables: Tables, parts: Iterable[str]) -> DataFrame:
    """One row per (project, SOV line): labor, material and amounts of the latest application.

    A line's own last application only counts if it is the project's; that is checked on
    the line totals, a few rows per project, instead of joining the billing lines to their
    maximum.
    """
    frames, aggregates = [], []
    for part in parts:
        if part == "billed":
            frames.append(_line_billing(tables))
            aggregates += [
                F.max("application_number").alias("line_application"),
                F.max_by("total_billed", "application_number").alias("total_billed"),
            ]
        else:
            frames.append(PARTS[part][0](tables))
            aggregates += PARTS[part][1]()
    lines = stack(frames).groupBy("project_id", "sov_line_id").agg(*aggregates)
    if "line_application" not in lines.columns:
        return lines
    latest = F.max("line_application").over(Window.partitionBy("project_id"))
    return lines.withColumn("latest_application", latest).withColumn(
        "total_billed", F.when(F.col("line_application") == F.col("latest_application"), F.col("total_billed"))
    ).drop("line_application", "latest_application")
