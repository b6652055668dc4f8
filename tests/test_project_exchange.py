"""The weekly chain up to project sums meets by project once, and repeated or missing keys give what joins would."""

import datetime as dt

from pyspark.sql import functions as F

from jobmargin.plans import earned_value as ev
from tests.portfolio import portfolio


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_no_join_and_no_second_exchange_by_project(spark):
    text = plan(ev.project_week(portfolio(spark)))
    assert "Join" not in text
    above = text[:text.index("Exchange ")]
    assert above.count("Window") >= 2 and "Aggregate" in above and "Generate" in above


def test_repeated_and_missing_keys(spark):
    tables = dict(portfolio(spark))
    budget, history, lines = tables["sov_budget"], tables["billing_history"], tables["billing_line_items"]
    nobody = F.lit(None).cast("string")
    tables["sov_budget"] = budget.union(budget.withColumn("estimated_labor_cost", F.col("estimated_labor_cost") + 1)).union(
        budget.withColumn("sov_line_id", nobody))
    later = history.withColumn("period_end", F.date_add("period_end", 7)).union(history.withColumn("period_end", F.lit(None).cast("date")))
    tables["billing_history"] = history.union(later).union(history.withColumn("project_id", nobody))
    tables["billing_line_items"] = lines.union(lines).union(lines.withColumn("application_number", F.lit(None).cast("int"))).union(
        lines.withColumn("project_id", nobody))

    weeks = ev.billing_week(tables).where(F.col("project_id").isNotNull())
    got = ev.fact_line_week(tables).where("description <> '' or total_billed <> 0")
    columns = [*ev.LINE_WEEK, "total_billed", "scheduled_value"]
    billed = weeks.where("coalesce(description, '') <> '' or coalesce(total_billed, 0) <> 0").select(
        *ev.LINE_WEEK, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns[3:]])
    assert rows_of(got, columns) == rows_of(billed, columns) != []

    joined = ev._with_budget(tables, ev.fact_line_week_td(tables))
    assert joined.columns == ev.earned_value(tables).columns
    assert rows_of(joined, joined.columns) == rows_of(ev.earned_value(tables), joined.columns)
    assert all(isinstance(r[2], dt.date) for r in rows_of(joined, joined.columns))
