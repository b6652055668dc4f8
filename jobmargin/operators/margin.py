"""Bid against realized margin."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.operators.portfolio import for_project
from jobmargin.plans import ledger
from jobmargin.session import materialise

Tables = Mapping[str, DataFrame]

RANK_BUCKETS = 256
RANK_ACCURACY = 10_000


def _project_margins(tables: Tables) -> DataFrame:
    rows = ledger.with_contract(
        tables, ledger.project_ledger(tables, ["budget", "labor", "material", "billed"]),
        "project_name", "original_contract_value",
    )
    value = F.col("original_contract_value")
    bid, billed, cost = m.zero_if_null("bid_cost"), m.zero_if_null("total_billed"), m.actual_cost()
    return rows.select(
        "project_id",
        "project_name",
        m.dbl(value).alias("contract_value"),
        m.dbl(bid).alias("bid_cost"),
        m.bid_margin(value, bid).alias("bid_margin"),
        m.dbl(cost).alias("actual_cost"),
        m.dbl(billed).alias("billed"),
        m.realized_margin(billed, cost).alias("realized_margin"),
        m.margin_delta(value, bid, billed, cost).alias("margin_delta"),
    )


def margin_by_project(tables: Tables) -> DataFrame:
    """Contract value, costs, both margins and their difference per project."""
    return _project_margins(tables).orderBy("project_id")


def margin_by_sov_line(tables: Tables, project_id: str | None = None) -> DataFrame:
    """The same per budgeted SOV line; variance is bid minus actual cost."""
    budget = for_project(tables["sov_budget"], project_id).select(
        "project_id", "sov_line_id", m.bid_cost().alias("bid_cost")
    )
    sov = tables["sov"].select("sov_line_id", "line_number", "description", "scheduled_value")
    facts = for_project(ledger.line_ledger(tables, ["labor", "material", "billed"]), project_id)
    rows = budget.join(sov, "sov_line_id").join(facts, ["project_id", "sov_line_id"], "left")
    value, bid = F.col("scheduled_value"), F.col("bid_cost")
    billed, cost = m.zero_if_null("total_billed"), m.actual_cost()
    return rows.select(
        "project_id",
        "sov_line_id",
        F.col("line_number").cast("bigint").alias("line_number"),
        "description",
        m.dbl(value).alias("scheduled_value"),
        m.dbl(bid).alias("bid_cost"),
        m.bid_margin(value, bid).alias("bid_margin"),
        m.dbl(cost).alias("actual_cost"),
        m.dbl(m.zero_if_null("actual_labor_cost")).alias("actual_labor_cost"),
        m.dbl(m.zero_if_null("actual_material_cost")).alias("actual_material_cost"),
        m.dbl(billed).alias("billed"),
        m.realized_margin(billed, cost).alias("realized_margin"),
        m.dbl(bid - cost).alias("variance"),
    ).orderBy("project_id", "line_number", "sov_line_id")


def margin_rank(tables: Tables) -> DataFrame:
    """Projects with their rank by margin erosion, worst first.

    The rank of a project is one plus the number of projects with a lower delta.
    Ranking in one window would sort the whole portfolio in a single task.  Instead
    distinct deltas are counted, cut into ordered buckets at quantiles from a sketch and
    ranked inside each; only the bucket totals are summed up in one task.  The counts are
    exact wherever the edges lie.  Eager: the margins, one row per project, are written
    once because the ranking reads them three times.
    """
    margins = materialise(_project_margins(tables).select(
        "project_id", "project_name", "bid_margin", "realized_margin", "margin_delta"
    ), "project-margins")
    per_delta = margins.groupBy("margin_delta").agg(F.count(F.lit(1)).alias("projects"))
    shares = [k / RANK_BUCKETS for k in range(1, RANK_BUCKETS)]
    cuts = margins.agg(F.percentile_approx("margin_delta", shares, RANK_ACCURACY)).first()[0] or []
    edges = F.array(*[F.lit(cut) for cut in cuts]).cast("array<double>")
    # Lower buckets hold only lower deltas.
    per_delta = per_delta.withColumn("bucket", F.size(F.filter(edges, lambda edge: edge <= F.col("margin_delta"))))
    below_bucket = per_delta.groupBy("bucket").agg(F.sum("projects").alias("in_bucket")).select(
        "bucket",
        (F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).alias("below_bucket"),
    )
    inside = Window.partitionBy("bucket").orderBy("margin_delta")
    ranks = (
        per_delta.withColumn("below_inside", F.sum("projects").over(inside) - F.col("projects"))
        .join(below_bucket, "bucket")
        .select("margin_delta", (F.col("below_bucket") + F.col("below_inside") + 1).alias("margin_rank"))
    )
    return margins.join(ranks, "margin_delta").select(
        "margin_rank", "project_id", "project_name", "bid_margin", "realized_margin", "margin_delta"
    ).orderBy("margin_rank", "project_id")


def labor_cost_by_sov_line(tables: Tables) -> DataFrame:
    return (
        tables["labor_logs"]
        .groupBy("sov_line_id")
        .agg(m.dbl(F.sum(m.labor_cost())).alias("labor_cost"))
    )
