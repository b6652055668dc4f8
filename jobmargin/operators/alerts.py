"""Risk alerts per project.

All four rules read one project ledger: a project becomes a row of measures, and each
rule that holds turns into one element of an array that is exploded.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.functions.text import dollars, percent
from jobmargin.plans import ledger

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Thresholds:
    scope_high: Decimal = Decimal("50000")
    labor_factor: Decimal = Decimal("1.1")
    labor_high: Decimal = Decimal("0.2")
    lag: Decimal = Decimal("0.1")
    lag_high: Decimal = Decimal("0.2")
    pending: Decimal = Decimal("100000")


def _alert(holds: Column, kind: str, severity: Column, message: Column, amount: Column) -> Column:
    return F.when(holds, F.struct(
        F.lit(kind).alias("type"), severity.alias("severity"), message.alias("message"),
        m.dbl(amount).alias("amount"),
    ))


def _severity(high: Column) -> Column:
    return F.when(high, "high").otherwise("medium")


def _scope_creep(t: Thresholds) -> Column:
    count, amount = F.col("recoverable_count"), F.col("recoverable_cost")
    message = F.concat(
        count.cast("string"), F.lit(" unsubmitted scope creep item(s) totaling "), dollars(amount)
    )
    return _alert(count > 0, "scope_creep", _severity(amount > F.lit(t.scope_high)), message, amount)


def _labor_overrun(t: Thresholds) -> Column:
    actual, budget = m.zero_if_null("actual_labor_cost"), m.zero_if_null("budget_labor_cost")
    over = actual - budget
    message = F.concat(
        F.lit("Labor cost "), dollars(actual), F.lit(" exceeds budget "), dollars(budget),
        F.lit(" by "), percent(m.share(over, budget)),
    )
    high = (budget != 0) & (over > budget * F.lit(t.labor_high))
    return _alert(actual > budget * F.lit(t.labor_factor), "labor_overrun", _severity(high), message, over)


def _billing_lag(t: Thresholds) -> Column:
    cost, billed = m.actual_cost(), m.zero_if_null("total_billed")
    lag = m.billing_lag(cost, billed)
    message = F.concat(
        F.lit("Costs exceed billing by "), percent(m.share(lag, billed)), F.lit(" — actual "),
        dollars(cost), F.lit(" vs billed "), dollars(billed),
    )
    holds = (billed > 0) & (lag > billed * F.lit(t.lag))
    return _alert(holds, "billing_lag", _severity(lag > billed * F.lit(t.lag_high)), message, lag)


def _pending_co(t: Thresholds) -> Column:
    amount = F.col("pending_amount")
    message = F.concat(
        F.col("pending_count").cast("string"), F.lit(" pending change order(s) totaling "), dollars(amount)
    )
    return _alert(amount > F.lit(t.pending), "pending_co", F.lit("high"), message, amount)


RULES = {
    "scope_creep": (_scope_creep, ("scope",)),
    "labor_overrun": (_labor_overrun, ("budget", "labor")),
    "billing_lag": (_billing_lag, ("labor", "material", "billed")),
    "pending_co": (_pending_co, ("change_orders",)),
}


def _alerts(tables: Tables, kinds: Iterable[str], thresholds: Thresholds) -> DataFrame:
    kinds = list(kinds)
    parts = list(dict.fromkeys(p for kind in kinds for p in RULES[kind][1]))
    rows = ledger.with_contract(tables, ledger.project_ledger(tables, parts), "project_name")
    raised = F.array_compact(F.array(*[RULES[kind][0](thresholds) for kind in kinds]))
    return rows.select("project_id", "project_name", F.explode(raised).alias("alert")).select(
        "alert.type", "alert.severity", "project_id", "project_name", "alert.message", "alert.amount"
    )


def alert_scope_creep(tables: Tables, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Projects with recoverable scope that nobody submitted."""
    return _alerts(tables, ["scope_creep"], thresholds)


def alert_labor_overrun(tables: Tables, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Projects whose labor exceeds budget by more than the factor."""
    return _alerts(tables, ["labor_overrun"], thresholds)


def alert_billing_lag(tables: Tables, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Projects whose cost runs ahead of billing."""
    return _alerts(tables, ["billing_lag"], thresholds)


def alert_pending_co(tables: Tables, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Projects with a large pending change-order amount."""
    return _alerts(tables, ["pending_co"], thresholds)


def risk_alerts(tables: Tables, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """All alerts, high severity first, then by amount."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return _alerts(tables, RULES, thresholds).orderBy(rank, F.desc("amount"), "project_id", "type")
