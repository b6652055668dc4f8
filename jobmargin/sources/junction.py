"""Change orders to the SOV lines they affect."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _exploded(tables: Mapping[str, DataFrame], *carry: str) -> DataFrame:
    as_json = F.replace(F.col("affected_sov_lines"), F.lit("'"), F.lit('"'))
    return tables["change_orders"].select(
        "project_id",
        "co_number",
        *carry,
        F.explode(F.from_json(as_json, "array<string>")).alias("sov_line_id"),
    )


def co_sov_lines(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per change order and affected line.

    The list is a Python literal with single quotes.  Lists that do not parse, as
    well as missing and empty ones, give no row.
    """
    return _exploded(tables)


def co_impact_by_sov_line(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Change orders touching each SOV line: count and full amount.

    A change order on several lines counts in full on each of them, so amounts do
    not add up across lines.
    """
    impact = (
        _exploded(tables, "amount")
        .groupBy("sov_line_id")
        .agg(F.count(F.lit(1)).alias("co_count"), F.sum("amount").alias("co_amount"))
    )
    return (
        tables["sov"]
        .select("project_id", "sov_line_id", "description")
        .join(impact, "sov_line_id")
        .select(
            "project_id", "sov_line_id", "description", "co_count",
            F.col("co_amount").cast("double").alias("co_amount"),
        )
        .orderBy("project_id", "sov_line_id")
    )
