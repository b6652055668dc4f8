"""Where margin leaks: project closeout, top leaks and leak classes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.functions.medians import median_of_large_groups
from jobmargin.plans import earned_value as ev
from jobmargin.plans import ledger
from jobmargin.session import materialise

Tables = Mapping[str, DataFrame]

TOP_LEAKS = 15

# The published class names.
UNBUDGETED = "Unbudgeted labor (scope/coding gap)"
EARLY_DRIFT = "Early productivity drift (hours-driven)"
TERMINAL_UNITS = "Terminal units labor overrun (recurring)"
CONTROLS = "Controls/commissioning labor overrun (recurring)"
OVERTIME = "Schedule pressure / overtime-driven labor leak"
LATE = "Late or gradual labor overrun"
RECOVERED = "Early drift recovered"
ON_TRACK = "On-track / underrun"


@dataclass(frozen=True)
class LeakRule:
    """Cut-offs of the classification.  They are this library's own choice."""

    early_norm: float = 1.0
    overtime_share: float = 0.10
    recurring_projects: int = 3
    terminal_words: str = "terminal unit"
    controls_words: tuple[str, ...] = ("controls", "commissioning")


def project_closeout_summary(tables: Tables) -> DataFrame:
    """Project totals at closeout with scaled variances, line count, value and scales."""
    lines = ev.scaled_variance(tables).groupBy("project_id", "labor_scale", "mat_scale").agg(
        F.sum("labor_cost_td").alias("labor"),
        F.sum("material_cost_td").alias("material"),
        F.sum("estimated_labor_cost").alias("labor_budget"),
        F.sum("estimated_material_cost").alias("material_budget"),
        F.count(F.lit(1)).alias("num_sov_lines"),
    )
    values = tables["sov"].groupBy("project_id").agg(F.sum("scheduled_value").alias("value"))
    labor_var = m.dbl("labor") - m.dbl("labor_budget") * F.col("labor_scale")
    material_var = m.dbl("material") - m.dbl("material_budget") * F.col("mat_scale")
    return (
        lines.join(values, "project_id", "left")
        .join(ev.last_period_end(tables), "project_id", "left")
        .select(
            "project_id",
            m.dbl("labor").alias("total_labor_cost"),
            m.dbl("material").alias("total_material_cost"),
            labor_var.alias("total_labor_var_scaled"),
            (labor_var + material_var).alias("total_var_scaled"),
            "num_sov_lines",
            m.dbl("value").alias("scheduled_value"),
            "last_period_end",
            "labor_scale",
            "mat_scale",
        )
    )


def _measured_lines(tables: Tables) -> DataFrame:
    scale = F.col("labor_scale") + ev.EPS
    return ev.scaled_variance(tables).select(
        "project_id", "sov_line_id", "description", "labor_cost_td", "estimated_labor_cost",
        "var_labor_scaled", "var_total_scaled", "ot_ratio_td",
        (F.col("labor_cost_ratio") / scale).alias("labor_overrun_norm"),
        (F.col("early_burn") / scale).alias("labor_bm_cost_norm"),
    )


def _with_sov_description(tables: Tables, lines: DataFrame) -> DataFrame:
    sov = tables["sov"].select("sov_line_id", F.col("description").alias("sov_description"))
    return lines.join(sov, "sov_line_id", "left")


def _leaking_descriptions(lines: DataFrame) -> DataFrame:
    return (
        lines.where(F.col("var_labor_scaled") > 0)
        .groupBy("sov_description")
        .agg(
            F.count_distinct("project_id").alias("leaking_projects"),
            F.count(F.lit(1)).alias("leaking_lines"),
        )
    )


def cross_project_pattern(tables: Tables, min_projects: int = LeakRule.recurring_projects) -> DataFrame:
    """Work descriptions whose labor leaks in several projects."""
    lines = _with_sov_description(tables, _measured_lines(tables))
    return _leaking_descriptions(lines).where(F.col("leaking_projects") >= min_projects).select(
        F.col("sov_description").alias("description"), "leaking_projects", "leaking_lines"
    )


def leak_lines(tables: Tables, rule: LeakRule = LeakRule()) -> DataFrame:
    """Every closeout line with its leak class; the first matching class wins.

    A recurring leak needs to know the other projects' lines, so the measured closeout
    lines (one small row per SOV line) are written once and read twice, instead of
    running the weekly facts again.  Eager.
    """
    return classified(measured_lines(tables), rule)


def measured_lines(tables: Tables) -> DataFrame:
    """The closeout lines with their measures, written once (eager)."""
    return materialise(_with_sov_description(tables, _measured_lines(tables)), "closeout-lines")


def classified(lines: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """The measured lines with their leak class: a projection but for the recurring kinds."""
    text = F.lower(F.coalesce("sov_description", F.lit("")))
    is_controls = text.contains(rule.controls_words[0])
    for word in rule.controls_words[1:]:
        is_controls = is_controls | text.contains(word)
    kind = F.when(text.contains(rule.terminal_words), TERMINAL_UNITS).when(is_controls, CONTROLS)
    lines = lines.withColumn("kind", kind)

    recurring = (
        lines.where((F.col("var_labor_scaled") > 0) & F.col("kind").isNotNull())
        .groupBy("kind", "sov_description")
        .agg(F.count_distinct("project_id").alias("projects"))
        .where(F.col("projects") >= rule.recurring_projects)
        .select("kind", "sov_description", F.lit(True).alias("recurs"))
    )
    leaks = F.col("var_labor_scaled") > 0
    early = F.col("labor_bm_cost_norm") > rule.early_norm
    unbudgeted = (F.col("estimated_labor_cost") == 0) & (F.col("labor_cost_td") > 0)
    archetype = (
        F.when(unbudgeted, UNBUDGETED)
        .when(early & leaks, EARLY_DRIFT)
        .when(leaks & F.col("recurs"), F.col("kind"))
        .when(leaks & (F.col("ot_ratio_td") > rule.overtime_share), OVERTIME)
        .when(leaks, LATE)
        .when(early, RECOVERED)
        .otherwise(ON_TRACK)
    )
    # Most lines have no kind; only the others meet the recurring ones.
    of_kind = lines.where(F.col("kind").isNotNull()).join(recurring, ["kind", "sov_description"], "left")
    every = of_kind.unionByName(lines.where(F.col("kind").isNull()).withColumn("recurs", F.lit(None).cast("boolean")))
    return every.select(
        "project_id", "sov_line_id", "description", archetype.alias("archetype"),
        "var_labor_scaled", "var_total_scaled", "labor_overrun_norm", "ot_ratio_td", "labor_bm_cost_norm",
    )


def top_leaks(tables: Tables, limit: int = TOP_LEAKS, rule: LeakRule = LeakRule()) -> DataFrame:
    """The lines with the largest scaled labor variance."""
    return (
        leak_lines(tables, rule)
        .where(F.col("var_labor_scaled").isNotNull())
        .orderBy(F.desc("var_labor_scaled"), "sov_line_id")
        .limit(limit)
        .drop("var_total_scaled")
    )


def leak_archetypes(tables: Tables, rule: LeakRule = LeakRule()) -> DataFrame:
    """Per class: lines, projects, summed variances and the median early burn.

    The few classes hold all lines of the portfolio, so the median is taken by counting
    buckets instead of gathering a class in one task.  Classes are computed anew for each
    use from the measured lines, which are written once.
    """
    lines = leak_lines(tables, rule)
    # Summed as decimals, so the totals do not depend on row order.
    exact = [F.sum(F.col(c).cast("decimal(28,10)")) for c in ("var_labor_scaled", "var_total_scaled")]
    totals = lines.groupBy("archetype").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("project_id").alias("projects"),
        m.dbl(exact[0]).alias("total_labor_var_scaled"),
        m.dbl(exact[1]).alias("total_var_scaled"),
    )
    medians = median_of_large_groups(lines, "archetype", "labor_bm_cost_norm", "median_early_bm")
    return totals.join(medians, "archetype", "left")


def frequent_sets(rows: DataFrame, holder: str, item: str, least: int, largest: int) -> DataFrame:
    """(items, size, holders): sets of 2 to `largest` items that `least` holders have together (eager).

    Level by level: a set is counted only for holders of two frequent sets that differ in their last
    item, so what no longer occurs often enough is never extended.  Counts are summed map-side; a
    holder's sets meet by (holder, all items but the last).  Nulls take no part.
    """
    single = rows.select(F.col(holder).alias("holder"), F.col(item).alias("last")).dropna().distinct()
    level = single.withColumn("lead", F.array().cast("array<string>"))
    found = []
    for size in range(1, largest + 1):
        frequent = level.groupBy("lead", "last").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") >= least)
        frequent = materialise(frequent, "frequent-sets")
        if size > 1:
            items = F.array_join(F.array_append("lead", F.col("last")), " + ")
            found.append(frequent.select(items.alias("items"), F.lit(size).cast("bigint").alias("size"), "holders"))
        if size == largest or frequent.isEmpty():
            break
        kept = materialise(level.join(frequent.select("lead", "last"), ["lead", "last"], "left_semi"), "holders-of-sets")
        other = kept.select("holder", "lead", F.col("last").alias("next"))
        level = kept.join(other, ["holder", "lead"]).where(F.col("last") < F.col("next")).select(
            "holder", F.array_append("lead", F.col("last")).alias("lead"), F.col("next").alias("last"))
    return ledger.stack(found) if found else single.sparkSession.createDataFrame([], "items string, size bigint, holders bigint")


def co_leaking_work(tables: Tables, least: int = LeakRule.recurring_projects, largest: int = 3) -> DataFrame:
    """Kinds of work whose labor leaks together in several projects: items in order, size and projects (eager)."""
    lines = _with_sov_description(tables, _measured_lines(tables)).where(F.col("var_labor_scaled") > 0)
    return frequent_sets(lines, "project_id", "sov_description", least, largest).withColumnRenamed("holders", "projects")
