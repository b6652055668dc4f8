"""Weekly earned-value facts per SOV line.

Labor and material are first summed per line and day, map-side, so that raw entries and
very large projects lose their weight before anything is brought together by project.
These daily rows, the billing lines, the periods of their applications, each project's last
billing period and the budgets are then stacked and shuffled once, by project: cutoff,
billing weeks and budgets are windows over the stack instead of joins, and the weekly sums,
all running totals and sums per project reuse that one partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.functions.dates import week_end_sunday
from jobmargin.plans import ledger
from jobmargin.session import parts_by_input

Tables = Mapping[str, DataFrame]

LINE = ["project_id", "sov_line_id"]
LINE_WEEK = [*LINE, "week_end"]
EPS = 1e-9
MIN_PCT = 5
PERCENT = Decimal("0.01")
PARTS = 4              # partitions by project for each of spark.sql.shuffle.partitions: rows widen manyfold after the shuffle
SHARE = 2 << 20        # bytes of labor input for each partition at most
ADVISORY = "8m"        # of what a shuffle holds compressed, for a partition of daily and weekly sums

LABOR_WEEKLY = ("labor_hours_w", "labor_cost_w", "st_hours_w", "ot_hours_w")
MATERIAL_WEEKLY = ("material_cost_w", "material_qty_w")
WEEKLY = LABOR_WEEKLY + MATERIAL_WEEKLY
SNAPSHOT = ("pct_complete", "total_billed", "scheduled_value")
BUDGET = ("estimated_labor_hours", "estimated_labor_cost", "estimated_material_cost", "productivity_factor")


def last_period_end(tables: Tables) -> DataFrame:
    return tables["billing_history"].groupBy("project_id").agg(F.max("period_end").alias("last_period_end"))


def closeout_cutoff(tables: Tables, name: str) -> DataFrame:
    """Rows of labor_logs or material_deliveries up to the project's last billing period.

    A project without billing loses all its rows.
    """
    rows = tables[name].join(last_period_end(tables), "project_id")
    return rows.where(F.col("date") <= F.col("last_period_end"))


def _labor_entries(tables: Tables) -> DataFrame:
    return tables["labor_logs"].select(
        *LINE,
        "date",
        m.labor_hours().alias("labor_hours_w"),
        m.labor_cost().alias("labor_cost_w"),
        F.col("hours_st").alias("st_hours_w"),
        F.col("hours_ot").alias("ot_hours_w"),
    )


def _material_entries(tables: Tables) -> DataFrame:
    return tables["material_deliveries"].select(
        *LINE,
        "date",
        F.col("total_cost").alias("material_cost_w"),
        F.col("quantity").alias("material_qty_w"),
    )


def _daily(entries: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return entries.groupBy(*LINE, "date").agg(*[F.sum(c).alias(c) for c in columns])


def _by_project(tables: Tables, rows: DataFrame) -> DataFrame:
    """Rows dealt by project, in parts small enough that sorts and windows keep to memory however large the input."""
    parts = PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, parts_by_input(tables["labor_logs"], SHARE)), "project_id")


def _until_closeout(tables: Tables, daily: DataFrame) -> DataFrame:
    """Daily rows up to their project's last billing period.

    The project's last period travels as a row without a date, which sorts first, so a
    running maximum carries it to the project's dated rows.  A project has at most
    (lines x days) of these, however many entries are behind them.
    """
    stacked = _by_project(tables, ledger.stack([daily, last_period_end(tables)]))
    by_date = (
        Window.partitionBy("project_id").orderBy(F.col("date").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    dated = stacked.withColumn("last_period_end", F.max("last_period_end").over(by_date))
    return dated.where(F.col("date") <= F.col("last_period_end")).withColumn("week_end", week_end_sunday("date"))


def _weekly_sums(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*LINE_WEEK).agg(*[F.sum(c).alias(c) for c in columns])


def labor_week(tables: Tables) -> DataFrame:
    """Weekly hours and cost per line, after the cutoff."""
    daily = _daily(_labor_entries(tables), LABOR_WEEKLY)
    return _weekly_sums(_until_closeout(tables, daily), LABOR_WEEKLY)


def labor_week_uncut(tables: Tables) -> DataFrame:
    """Weekly labor per line without the cutoff, as a stream accumulates it."""
    entries = _labor_entries(tables).withColumn("week_end", week_end_sunday("date"))
    return _weekly_sums(entries, LABOR_WEEKLY)


def material_week(tables: Tables) -> DataFrame:
    """Weekly material cost and quantity per line, after the cutoff."""
    daily = _daily(_material_entries(tables), MATERIAL_WEEKLY)
    return _weekly_sums(_until_closeout(tables, daily), MATERIAL_WEEKLY)


def billing_week(tables: Tables) -> DataFrame:
    """Billing snapshot per line and week: highest percent, billed and scheduled value.

    The description is that of the lowest application that has one.  Lines whose
    application has no billing row have no week and are left out.
    """
    periods = tables["billing_history"].select("project_id", "application_number", "period_end")
    lines = tables["billing_line_items"].select(
        *LINE, "application_number", "description", "pct_complete", "total_billed", "scheduled_value"
    )
    described = F.when(F.col("description").isNotNull(), F.col("application_number"))
    return (
        lines.join(periods, ["project_id", "application_number"])
        .where(F.col("period_end").isNotNull())
        .groupBy(*LINE, week_end_sunday("period_end").alias("week_end"))
        .agg(
            F.max("pct_complete").alias("pct_complete"),
            F.max("total_billed").alias("total_billed"),
            F.max("scheduled_value").alias("scheduled_value"),
            F.min_by("description", described).alias("description"),
        )
    )


def _application_weeks(tables: Tables) -> DataFrame:
    """The weeks in which an application's periods end: one, unless its number repeats or no date is known."""
    return tables["billing_history"].groupBy("project_id", "application_number").agg(
        F.collect_set(week_end_sunday("period_end")).alias("weeks"))


def _billing_lines(tables: Tables) -> DataFrame:
    return tables["billing_line_items"].select(
        *LINE, "application_number", *SNAPSHOT, "description",
        F.when(F.col("description").isNotNull(), F.col("application_number")).alias("described"))


def _active_weeks(tables: Tables, *per_line: DataFrame) -> DataFrame:
    """Daily sums up to the last billing period and billing lines, each with its week; rows of `per_line` have none.

    In a project's window, rows without application come first and its last period before all
    others; then come the applications, the weeks of each before its lines.  So running values
    carry both along.  A billing line has a row for each week of its application; as in a join,
    null keys meet nothing.  They are told apart here, since filters on the billing tables would
    reach below their aggregates and keep Spark from running what both share once.
    """
    entries = ledger.stack([_labor_entries(tables), _material_entries(tables)])
    daily = _daily(entries, WEEKLY).where(F.col("date").isNotNull())
    frames = [daily, _billing_lines(tables), _application_weeks(tables), last_period_end(tables), *per_line]
    along = (
        Window.partitionBy("project_id")
        .orderBy(F.col("application_number").asc_nulls_first(), F.col("date").asc_nulls_first(), F.col("weeks").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    applied = F.when(F.col("weeks").isNotNull(), F.struct("application_number", "weeks"))
    rows = _by_project(tables, ledger.stack(frames)).withColumns({
        "last_period_end": F.max("last_period_end").over(along), "applied": F.last(applied, ignorenulls=True).over(along)})
    same = F.col("project_id").isNotNull() & (F.col("applied.application_number") == F.col("application_number"))
    own = F.when(same, F.col("applied.weeks"))
    undated = F.array(F.lit(None).cast("date"))
    kept = (
        F.when(F.col("weeks").isNotNull(), None)
        .when(F.col("application_number").isNotNull(), own)
        .when(F.col("date").isNotNull(), F.when(F.col("date") <= F.col("last_period_end"), F.array(week_end_sunday("date"))))
    )
    for frame in per_line:
        kept = kept.when(F.col(frame.columns[-1]).isNotNull(), undated)
    return rows.withColumn("week_end", F.explode(kept)).drop("weeks", "applied", "last_period_end")


def week_spine(tables: Tables) -> DataFrame:
    """The (project, line, week) keys with any labor, material or billing."""
    return _active_weeks(tables).select(*LINE_WEEK).distinct()


def _merged_weeks(rows: DataFrame, *per_line: str) -> DataFrame:
    """Sums, highest snapshot values and the description of the lowest application that has one, by line and week."""
    return rows.groupBy(*LINE_WEEK).agg(
        *[F.sum(c).alias(c) for c in WEEKLY], *[F.max(c).alias(c) for c in SNAPSHOT],
        F.min_by("description", "described").alias("description"), *[F.first(c, True).alias(c) for c in per_line],
    )


def fact_line_week(tables: Tables) -> DataFrame:
    """One row per active line and week; measures without activity are 0, text is empty."""
    return _filled(_merged_weeks(_active_weeks(tables)))


def _filled(fact: DataFrame, *others: str) -> DataFrame:
    pct = F.greatest(F.lit(0), F.least(F.lit(100), m.zero_if_null("pct_complete")))
    return fact.select(
        *LINE_WEEK,
        *[m.zero_if_null(c).alias(c) for c in WEEKLY],
        pct.cast("decimal(5,2)").alias("pct_complete"),
        m.zero_if_null("total_billed").alias("total_billed"),
        m.zero_if_null("scheduled_value").alias("scheduled_value"),
        F.coalesce("description", F.lit("")).alias("description"),
        *others,
    )


def fact_line_week_td(tables: Tables) -> DataFrame:
    """Adds to-date columns: running sums of spend, running maxima of percent and billed.

    Also marks the last active week (``is_closeout``) and keeps labor cost and percent of
    the first week at MIN_PCT or more.  All windows share one exchange and one sort, and
    Spark drops those a query does not use.
    """
    return _to_date(fact_line_week(tables))


def _to_date(fact: DataFrame) -> DataFrame:
    ordered = Window.partitionBy(*LINE).orderBy("week_end")
    to_date = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = {"labor_hours_w": "labor_hours_td", "labor_cost_w": "labor_cost_td",
              "material_cost_w": "material_cost_td", "st_hours_w": "st_hours_td", "ot_hours_w": "ot_hours_td"}
    highest = {"pct_complete": "pct_complete_td", "total_billed": "total_billed_td"}
    running = fact.select(
        "*",
        *[F.sum(c).over(to_date).alias(name) for c, name in summed.items()],
        *[F.max(c).over(to_date).alias(name) for c, name in highest.items()],
        F.lead("week_end").over(ordered).isNull().alias("is_closeout"),
    )
    started = F.col("pct_complete_td") >= MIN_PCT
    return running.withColumns({
        f"early_{c}": F.first(F.when(started, F.col(c)), ignorenulls=True).over(to_date)
        for c in ("labor_cost_td", "pct_complete_td")
    })


def _with_budget(tables: Tables, rows: DataFrame) -> DataFrame:
    return _earned(rows.join(tables["sov_budget"].select(*LINE, *BUDGET), LINE, "left"))


def _earned(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({c: m.zero_if_null(c) for c in BUDGET})
    hours, factor = F.col("estimated_labor_hours"), F.col("productivity_factor")
    # Cost is earned in decimals, hence exact and independent of summing order later.
    done = F.col("pct_complete_td") * PERCENT
    return rows.withColumn(
        "budget_hours_adj", F.when(factor > 0, m.dbl(hours) / m.dbl(factor)).otherwise(m.dbl(hours))
    ).withColumns({
        "earned_labor_cost_td": F.col("estimated_labor_cost") * done,
        "earned_labor_hours_td": F.col("budget_hours_adj") * (m.dbl("pct_complete_td") / 100.0),
        "earned_material_cost_td": F.col("estimated_material_cost") * done,
    })


def earned_value(tables: Tables) -> DataFrame:
    """Adds budget and earned columns: budget times percent complete.

    Budget hours are divided by the productivity factor where that is positive.  A line's budget
    rows travel in the stack as one row without a week, which sorts first and is carried to the
    line's weeks; each week comes out once for each of them, as from a left join.
    """
    budgets = tables["sov_budget"].dropna(subset=LINE).groupBy(*LINE).agg(F.collect_list(F.struct(*BUDGET)).alias("budgets"))
    to_date = Window.partitionBy(*LINE).orderBy("week_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weeks = _merged_weeks(_active_weeks(tables, budgets), "budgets")
    weeks = weeks.withColumn("budgets", F.first("budgets", True).over(to_date)).where(F.col("week_end").isNotNull())
    rows = _to_date(_filled(weeks, "budgets"))
    return _earned(rows.select(*[c for c in rows.columns if c != "budgets"], F.inline_outer("budgets")))


def over(numerator: Column, denominator: Column) -> Column:
    """Ratio with EPS in the denominator."""
    return m.dbl(numerator) / (m.dbl(denominator) + EPS)


def _with_signatures(rows: DataFrame) -> DataFrame:
    started = F.col("pct_complete_td") >= MIN_PCT

    def burn(spent: str, earned: str, budget: str) -> Column:
        return F.when(started & (F.col(budget) > 0), over(F.col(spent), F.col(earned)))

    worked = F.col("st_hours_td") + F.col("ot_hours_td")
    spent = F.col("labor_cost_td") + F.col("material_cost_td")
    billed = F.col("total_billed_td")
    return rows.withColumns({
        "labor_burn_mult_cost": burn("labor_cost_td", "earned_labor_cost_td", "estimated_labor_cost"),
        "labor_burn_mult_hours": burn("labor_hours_td", "earned_labor_hours_td", "estimated_labor_hours"),
        "material_burn_mult_cost": burn(
            "material_cost_td", "earned_material_cost_td", "estimated_material_cost"),
        "ot_ratio_td": over(F.col("ot_hours_td"), worked),
        "billing_lag_ratio": F.when(billed > 0, over(spent, billed)),
    })


def burn_signatures(tables: Tables) -> DataFrame:
    """Adds burn multiples (NULL below MIN_PCT or without budget), overtime and billing-lag ratios."""
    return _with_signatures(earned_value(tables))


def fact_closeout(tables: Tables) -> DataFrame:
    """The last active week of each line, with cost over budget ratios (NULL without budget).

    The description is the last week's, so it is empty when nothing was billed then.
    ``early_burn`` is the line's first labor burn multiple.  Only closeout rows meet the
    budget.
    """
    last_weeks = fact_line_week_td(tables).where("is_closeout").drop("is_closeout")
    return _closed(_with_budget(tables, last_weeks))


def fact_closeout_from(earned: DataFrame) -> DataFrame:
    """The same from the rows of `earned_value`."""
    return _closed(earned.where("is_closeout").drop("is_closeout"))


def _closed(rows: DataFrame) -> DataFrame:
    rows = _with_signatures(rows)

    def ratio(spent: str, budget: str) -> Column:
        return F.when(F.col(budget) > 0, m.dbl(spent) / m.dbl(budget))

    early_earned = F.col("estimated_labor_cost") * (F.col("early_pct_complete_td") * PERCENT)
    early_burn = F.when(F.col("estimated_labor_cost") > 0, over(F.col("early_labor_cost_td"), early_earned))
    return rows.withColumns({
        "labor_cost_ratio": ratio("labor_cost_td", "estimated_labor_cost"),
        "mat_cost_ratio": ratio("material_cost_td", "estimated_material_cost"),
        "early_burn": early_burn,
    }).drop("early_labor_cost_td", "early_pct_complete_td")


def _scale(ratio: str, budget: str, spent: str) -> Column:
    return F.median(F.when((F.col(budget) > 0) & (F.col(spent) > 0), F.col(ratio)))


LABOR_SCALE = ("labor_cost_ratio", "estimated_labor_cost", "labor_cost_td")
MATERIAL_SCALE = ("mat_cost_ratio", "estimated_material_cost", "material_cost_td")


def project_scales(tables: Tables) -> DataFrame:
    """Median cost over budget ratio per project, over lines with budget and spend.

    A project's schedule of values is one document of numbered lines, so the rows of a
    project are few however much labor it has.
    """
    return fact_closeout(tables).groupBy("project_id").agg(
        _scale(*LABOR_SCALE).alias("labor_scale"), _scale(*MATERIAL_SCALE).alias("mat_scale")
    )


def scaled_variance(tables: Tables) -> DataFrame:
    """Closeout rows with scales and spend minus scaled budget; NULL where the scale is.

    The scales are window medians over the project's lines, which spares a second pass
    over the weekly facts.
    """
    project = Window.partitionBy("project_id")
    rows = fact_closeout(tables).withColumns({
        "labor_scale": _scale(*LABOR_SCALE).over(project),
        "mat_scale": _scale(*MATERIAL_SCALE).over(project),
    })
    labor = m.dbl("labor_cost_td") - m.dbl("estimated_labor_cost") * F.col("labor_scale")
    material = m.dbl("material_cost_td") - m.dbl("estimated_material_cost") * F.col("mat_scale")
    return rows.withColumns({
        "var_labor_scaled": labor,
        "var_material_scaled": material,
        "var_total_scaled": labor + material,
    })


def _project_signatures(rows: DataFrame) -> DataFrame:
    columns = ("labor_cost_td", "material_cost_td", "earned_labor_cost_td", "earned_material_cost_td",
               "total_billed_td", "ot_hours_td", "st_hours_td")
    sums = rows.groupBy("project_id", "week_end").agg(*[F.sum(c).alias(c) for c in columns]).withColumns({
        "total_cost_td": F.col("labor_cost_td") + F.col("material_cost_td"),
        "earned_cost_td": F.col("earned_labor_cost_td") + F.col("earned_material_cost_td"),
    })
    worked = F.col("ot_hours_td") + F.col("st_hours_td")
    billed = F.col("total_billed_td")
    return sums.withColumns({
        "burn_mult_cost": over(F.col("total_cost_td"), F.col("earned_cost_td")),
        "labor_burn_mult_cost": over(F.col("labor_cost_td"), F.col("earned_labor_cost_td")),
        "material_burn_mult_cost": over(F.col("material_cost_td"), F.col("earned_material_cost_td")),
        "ot_ratio_td": over(F.col("ot_hours_td"), worked),
        "billing_lag_ratio": F.when(billed > 0, over(F.col("total_cost_td"), billed)),
    })


def project_week(tables: Tables) -> DataFrame:
    """Project-week sums of the to-date columns, over the lines active in that week only."""
    return _project_signatures(earned_value(tables))


def project_week_from(fact_week: DataFrame) -> DataFrame:
    """The same from a fact that was written and read back."""
    return _project_signatures(fact_week)


def project_week_dense(tables: Tables) -> DataFrame:
    """Project-week totals that carry every line's last known to-date values forward.

    A line's step from its previous week is summed by project and week, and the steps
    accumulate; no (line x week) grid is built.
    """
    columns = ("labor_cost_td", "material_cost_td", "earned_labor_cost_td", "earned_material_cost_td",
               "total_billed_td", "ot_hours_td", "st_hours_td")
    by_line = Window.partitionBy(*LINE).orderBy("week_end")
    steps = earned_value(tables).select(
        "project_id", "week_end",
        *[(F.col(c) - F.coalesce(F.lag(c).over(by_line), F.lit(0))).alias(c) for c in columns],
    )
    weekly = steps.groupBy("project_id", "week_end").agg(*[F.sum(c).alias(c) for c in columns])
    to_date = (
        Window.partitionBy("project_id").orderBy("week_end")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return weekly.select(
        "project_id", "week_end", *[F.sum(c).over(to_date).alias(c) for c in columns]
    )
