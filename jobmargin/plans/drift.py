"""Early signs that a line burns more labor than it earns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.plans import earned_value as ev

Tables = Mapping[str, DataFrame]

SLACK = "0.01"         # share of the budget that a week may cost beyond what it earns
SIGNAL = "0.10"        # share of the budget from which the accumulated excess is a signal
WEEKS = 4


def rolling_burn(tables: Tables, slack: str = SLACK, weeks: int = WEEKS) -> DataFrame:
    """Labor burn over the last weeks of the calendar, and the accumulated excess, per line and active week.

    `burn_4w` is cost over earned cost of the last `weeks` weeks, weeks without activity included; NULL where
    nothing was earned.  `excess` is a one-sided cumulative sum: each week adds its cost less what
    it earned less `slack` of the budget, and the sum starts anew when it would fall below zero.  As a running
    sum less its running minimum it needs no recursion, and in decimals it is exact.  `since` is the
    first week of the present excess.  Lines without budget are left out.  All windows of a line share the
    partitioning of its running totals.
    """
    line = Window.partitionBy(*ev.LINE)
    ordered = line.orderBy("week_end")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    recent = line.orderBy(F.unix_date("week_end")).rangeBetween(1 - 7 * weeks, Window.currentRow)
    rows = ev.earned_value(tables).where(F.col("estimated_labor_cost") > 0).select(
        *ev.LINE_WEEK, "labor_cost_w", F.col("estimated_labor_cost").alias("budget"),
        (F.col("earned_labor_cost_td") - F.coalesce(F.lag("earned_labor_cost_td").over(ordered), F.lit(0))).alias("earned_w"),
    )
    rows = rows.withColumns({
        "cost_4w": F.sum("labor_cost_w").over(recent), "earned_4w": F.sum("earned_w").over(recent),
        "walk": F.sum(F.col("labor_cost_w") - F.col("earned_w") - F.col("budget") * m.as_decimal(slack)).over(running),
    })
    rows = rows.withColumn("excess", F.col("walk") - F.least(F.lit(0), F.min("walk").over(running)))
    anew = F.when(F.col("excess") == 0, F.lead("week_end").over(ordered))
    rows = rows.withColumn("anew", anew).withColumn(
        "since", F.when(F.col("excess") > 0, F.coalesce(F.last("anew", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)),
                                                        F.min("week_end").over(running))))
    return rows.drop("walk", "anew").withColumn(
        "burn_4w", F.when(F.col("earned_4w") != 0, m.dbl("cost_4w") / m.dbl("earned_4w")))


def burn_change_points(tables: Tables, slack: str = SLACK, signal: str = SIGNAL, weeks: int = WEEKS) -> DataFrame:
    """The first week in which a line's excess passes `signal` of its budget, and the week since which it has built up."""
    first = rolling_burn(tables, slack, weeks).where(F.col("excess") > F.col("budget") * m.as_decimal(signal)).groupBy(*ev.LINE).agg(
        F.min_by(F.struct("week_end", "since", "excess", "burn_4w", "budget"), "week_end").alias("s"))
    return first.select(
        *ev.LINE, F.col("s.week_end").alias("signal_week"), F.col("s.since").alias("change_week"),
        (F.date_diff("s.week_end", "s.since") / 7).cast("bigint").alias("weeks_to_signal"),
        m.dbl("s.excess").alias("excess"), m.dbl("s.budget").alias("budget"), F.col("s.burn_4w").alias("burn_4w"))
