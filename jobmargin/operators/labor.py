"""Labor against budget per SOV line."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.functions.text import any_word
from jobmargin.operators.portfolio import for_project
from jobmargin.plans import earned_value as ev
from jobmargin.plans import ledger
from jobmargin.plans.intervals import join_in_periods

Tables = Mapping[str, DataFrame]

OVERRUN_FACTOR = "1.1"
CAUSE_WORDS = ("delay", "rework", "weather", "rain", "staffing", "shortage")


def _lines(tables: Tables, project_id: str | None, factor) -> DataFrame:
    budget = for_project(tables["sov_budget"], project_id).select(
        "project_id", "sov_line_id", "estimated_labor_hours", "estimated_labor_cost"
    )
    sov = tables["sov"].select("sov_line_id", "line_number", "description")
    names = tables["contracts"].select("project_id", "project_name")
    actual = for_project(ledger.line_ledger(tables, ["labor"]), project_id)
    rows = (
        budget.join(sov, "sov_line_id")
        .join(names, "project_id")
        .join(actual, ["project_id", "sov_line_id"], "left")
    )
    hours, cost = m.zero_if_null("actual_labor_hours"), m.zero_if_null("actual_labor_cost")
    return rows.select(
        "project_id", "project_name", "sov_line_id", "line_number", "description",
        F.col("estimated_labor_hours").alias("budgeted_hours"),
        hours.alias("actual_hours"),
        F.col("estimated_labor_cost").alias("budgeted_cost"),
        cost.alias("actual_cost"),
        (cost > F.col("estimated_labor_cost") * m.as_decimal(factor)).alias("flagged"),
    )


def labor_overruns(tables: Tables, project_id: str | None = None, factor=OVERRUN_FACTOR) -> DataFrame:
    """Budget, actual, variance and overrun share per budgeted line, with the overrun flag.

    A line without budget is flagged as soon as it has cost, while its share reads 0.
    """
    hours_variance = F.col("actual_hours") - F.col("budgeted_hours")
    cost_variance = F.col("actual_cost") - F.col("budgeted_cost")
    return _lines(tables, project_id, factor).select(
        "project_id", "project_name", "sov_line_id",
        F.col("line_number").cast("bigint").alias("line_number"),
        "description",
        m.dbl("budgeted_hours").alias("budgeted_hours"),
        m.dbl("actual_hours").alias("actual_hours"),
        m.dbl(hours_variance).alias("hours_variance"),
        m.share(hours_variance, F.col("budgeted_hours")).alias("hours_overrun_pct"),
        m.dbl("budgeted_cost").alias("budgeted_cost"),
        m.dbl("actual_cost").alias("actual_cost"),
        m.dbl(cost_variance).alias("cost_variance"),
        m.share(cost_variance, F.col("budgeted_cost")).alias("cost_overrun_pct"),
        "flagged",
    ).orderBy("project_id", "line_number", "sov_line_id")


def labor_overruns_flagged(tables: Tables, project_id: str | None = None,
                           factor=OVERRUN_FACTOR) -> DataFrame:
    return labor_overruns(tables, project_id, factor).where("flagged")


def labor_overrun_total(tables: Tables, project_id: str | None = None,
                        factor=OVERRUN_FACTOR) -> DataFrame:
    """Number of flagged lines and their summed cost variance."""
    variance = F.sum(F.col("actual_cost") - F.col("budgeted_cost"))
    return _lines(tables, project_id, factor).where("flagged").agg(
        F.count(F.lit(1)).alias("flagged_count"),
        m.dbl(m.zero_if_null(variance)).alias("total_overrun_amount"),
    )


def overrun_notes(tables: Tables, words: Iterable[str] = CAUSE_WORDS, factor=OVERRUN_FACTOR) -> DataFrame:
    """Field notes naming a cause, for projects with a flagged line."""
    flagged = _lines(tables, None, factor).where("flagged").select("project_id").distinct()
    notes = tables["field_notes"].where(any_word("content", words))
    return (
        notes.join(flagged, "project_id", "left_semi")
        .select("note_id", "project_id", "date", "note_type", "author", "content")
        .orderBy("project_id", F.desc("date"), "note_id")
    )


def overrun_periods(tables: Tables, factor=OVERRUN_FACTOR) -> DataFrame:
    """The periods in which a line's labor cost to date was over its budget by the factor.

    A period runs from the Monday of the first such week to the Sunday of the last in a row, counting the
    weeks with labor; a correction can end one.  `overrun` is the highest excess over the budget in it.
    A line without budget row has no period; one with a budget of 0 is over with its first cost.
    """
    weeks = ev.labor_week_uncut(tables).select(*ev.LINE_WEEK, "labor_cost_w")
    budget = tables["sov_budget"].select(*ev.LINE, F.col("estimated_labor_cost").alias("budget"))
    ordered = Window.partitionBy(*ev.LINE).orderBy("week_end")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = weeks.join(budget, ev.LINE).withColumn("cost_td", F.sum("labor_cost_w").over(running))
    over = spent.withColumn("over", F.col("cost_td") > F.col("budget") * m.as_decimal(factor))
    begins = F.col("over") & ~F.coalesce(F.lag("over").over(ordered), F.lit(False))
    numbered = over.withColumn("begins", begins).withColumn("period", F.sum(F.col("begins").cast("int")).over(running))
    periods = numbered.where("over").groupBy(*ev.LINE, "period").agg(
        F.date_sub(F.min("week_end"), 6).alias("over_from"), F.max("week_end").alias("over_to"),
        F.max(F.col("cost_td") - F.col("budget")).alias("overrun"),
    )
    return periods.select(*ev.LINE, "over_from", "over_to", m.dbl("overrun").alias("overrun"))


def overrun_period_notes(tables: Tables, words: Iterable[str] = CAUSE_WORDS, factor=OVERRUN_FACTOR) -> DataFrame:
    """Field notes naming a cause, with each line of their project that was over budget on their date."""
    notes = tables["field_notes"].where(any_word("content", words)).select("note_id", "project_id", "date", "note_type", "author")
    met = join_in_periods(notes, overrun_periods(tables, factor), ["project_id"], "date", "over_from", "over_to", "note_id")
    return met.select("project_id", "sov_line_id", "over_from", "over_to", "overrun", "note_id", "date", "note_type", "author").orderBy(
        "project_id", "sov_line_id", "over_from", "date", "note_id")
