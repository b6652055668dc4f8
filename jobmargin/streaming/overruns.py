"""Openings and closings of labor overruns as keyed state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jobmargin.functions import measures as m
from jobmargin.operators.labor import OVERRUN_FACTOR
from jobmargin.session import send_package
from jobmargin.streaming.labor import LATENESS

COST = pa.decimal128(38, 6)
DAY = 86_400_000       # milliseconds
EPOCH = dt.date(1970, 1, 1).toordinal()
EVENTS = (
    "project_id string, event string, reason string, actual_labor_cost decimal(38,6), "
    "budget_labor_cost decimal(38,6), overrun decimal(38,6), last_day date"
)
STATE = "cost decimal(38,6), budget decimal(38,6), open boolean, last_day date"


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a project and batch of a task, so that a project with a third of all entries is a few rows when it is shuffled."""
    for batch in batches:
        summed = pa.Table.from_batches([batch]).group_by("project_id").aggregate([("cost", "sum"), ("day", "max")])
        yield from summed.select(["project_id", "cost_sum", "day_max"]).rename_columns(["project_id", "cost", "day"]).cast(
            pa.schema([("project_id", pa.string()), ("cost", COST), ("day", pa.date32())])).to_batches()


class OverrunProcessor(StatefulProcessor):
    """Total labor cost of a project and whether it is over its budget; a row comes out only where that changes.

    With `quiet_days`, an event-time timer closes an overrun whose project has had no labor for so
    long; its total stays, so later labor opens it again.
    """

    def __init__(self, factor: str, quiet_days: int | None):
        self.factor, self.quiet_days = Decimal(factor), quiet_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("project", STATE)

    def handleInputRows(self, key, rows, timerValues):
        cost, budget, was_open, last = self.state.get() if self.state.exists() else (Decimal(0), Decimal(0), False, None)
        for row in rows:
            cost, budget = cost + (row.cost or 0), row.budget_labor_cost
            last = max(filter(None, (last, row.day)), default=None)
        is_open = cost > budget * self.factor
        self.state.update((cost, budget, is_open, last))
        if self.quiet_days is not None and last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if is_open:
                self.handle.registerTimer((last.toordinal() - EPOCH + self.quiet_days) * DAY)
        if is_open != was_open:
            yield _event(key[0], "opened" if is_open else "closed", "labor", cost, budget, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        cost, budget, is_open, last = self.state.get()
        if is_open:
            self.state.update((cost, budget, False, last))
            yield _event(key[0], "closed", "quiet", cost, budget, last)

    def close(self) -> None:
        pass


def _event(project_id, event, reason, cost, budget, last) -> Row:
    return Row(project_id=project_id, event=event, reason=reason, actual_labor_cost=cost,
               budget_labor_cost=budget, overrun=cost - budget, last_day=last)


def stream_overrun_events(entries: DataFrame, sov_budget: DataFrame, factor=OVERRUN_FACTOR,
                          quiet_days: int | None = None, lateness: str = LATENESS) -> DataFrame:
    """A row when a project's running labor cost first exceeds its budget by the factor, and when it no longer does.

    Corrections (negative entries) close an overrun.  Without `quiet_days` every entry counts,
    however late.  With it, entries later than the watermark are dropped and overruns without labor for so many days
    close with reason `quiet`.  `sov_budget` is read by each micro-batch, so it should be a stored
    table; a project without budget has a budget of 0.  State is one row a project.  Needs the
    RocksDB state store, which `runner.follow` sets for its query.
    """
    send_package(entries.sparkSession)
    budget = sov_budget.groupBy("project_id").agg(F.sum("estimated_labor_cost").cast("decimal(38,6)").alias("budget_labor_cost"))
    costs = entries.select("project_id", m.labor_cost().cast("decimal(38,6)").alias("cost"), F.col("date").alias("day"))
    sums = costs.mapInArrow(_partial_sums, "project_id string, cost decimal(38,6), day date")
    if quiet_days is not None:
        event_time = F.timestamp_seconds(F.unix_date("day") * 86400)
        sums = sums.withColumn("event_time", event_time).withWatermark("event_time", lateness)
    rows = sums.join(budget, "project_id", "left").withColumn("budget_labor_cost", m.zero_if_null("budget_labor_cost").cast("decimal(38,6)"))
    return rows.groupBy("project_id").transformWithState(
        OverrunProcessor(str(factor), quiet_days), EVENTS, "Update", "None" if quiet_days is None else "EventTime")
