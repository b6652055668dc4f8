"""Financial measures as column expressions.

Sums stay decimal, hence exact and independent of row order; ratios are double.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

OVERTIME_FACTOR = Decimal("1.5")
SCOPE_LABOR_RATE = Decimal("85")

PENDING_STATUSES = ("Pending", "Under Review")
RECOVERABLE_PARTIES = ("owner", "gc")


def as_decimal(value: int | float | str | Decimal) -> Column:
    """A decimal literal that keeps the digits the caller wrote."""
    return F.lit(Decimal(str(value)))


def dbl(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def zero_if_null(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))


def labor_hours() -> Column:
    """Straight plus overtime hours, overtime unweighted."""
    return F.col("hours_st") + F.col("hours_ot")


def labor_cost() -> Column:
    """Burdened cost with overtime at time and a half."""
    paid_hours = F.col("hours_st") + F.col("hours_ot") * F.lit(OVERTIME_FACTOR)
    return paid_hours * F.col("hourly_rate") * F.col("burden_multiplier")


def bid_cost() -> Column:
    return (
        F.col("estimated_labor_cost")
        + F.col("estimated_material_cost")
        + F.col("estimated_equipment_cost")
        + F.col("estimated_sub_cost")
    )


def actual_cost(labor: Column | str = "actual_labor_cost",
                material: Column | str = "actual_material_cost") -> Column:
    """Labor plus material.  Equipment and subcontracts have no actuals."""
    return zero_if_null(labor) + zero_if_null(material)


def scope_cost(rate: int | float | str | Decimal = SCOPE_LABOR_RATE) -> Column:
    """Estimated cost of a scope item: hours at a flat rate without burden, plus material."""
    return F.col("estimated_labor_hours") * as_decimal(rate) + F.col("estimated_material_cost")


def share(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as double, 0 where the denominator is 0."""
    return F.when(denominator != 0, dbl(numerator) / dbl(denominator)).otherwise(F.lit(0.0))


def share_if_positive(numerator: Column, denominator: Column) -> Column:
    """Like ``share`` but 0 for negative denominators too (the project table's rule)."""
    return F.when(denominator > 0, dbl(numerator) / dbl(denominator)).otherwise(F.lit(0.0))


def bid_margin(value: Column, cost: Column) -> Column:
    return share(value - cost, value)


def realized_margin(billed: Column, cost: Column) -> Column:
    return share(billed - cost, billed)


def margin_delta(value: Column, bid: Column, billed: Column, cost: Column) -> Column:
    """Realized minus bid margin; 0 where either has no denominator."""
    return F.when(
        (value != 0) & (billed != 0),
        dbl(billed - cost) / dbl(billed) - dbl(value - bid) / dbl(value),
    ).otherwise(F.lit(0.0))


def billing_lag(cost: Column, billed: Column) -> Column:
    """Cost not yet billed; positive means the contractor finances the work."""
    return cost - billed


def billing_lag_pct(cost: Column, billed: Column) -> Column:
    return share(cost - billed, billed)


def margin_band(margin: Column | str) -> Column:
    value = F.col(margin) if isinstance(margin, str) else margin
    return F.when(value > 0.15, "green").when(value > 0.10, "yellow").otherwise("red")


def is_pending(status: Column | str = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*PENDING_STATUSES)


def is_recoverable() -> Column:
    """Owner or general contractor caused it and no change order was submitted."""
    return F.col("responsibility").isin(*RECOVERABLE_PARTIES) & (F.col("co_status") == "not_submitted")


def is_absorbed() -> Column:
    return (F.col("co_status") == "absorbed") | (F.col("responsibility") == "self_absorbed")


def is_scope_pending() -> Column:
    return F.col("co_status").isin("pending", "awaiting_approval")


def is_rework() -> Column:
    return F.col("log_id").startswith("OVR-")
