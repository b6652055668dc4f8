"""Latest pay application per project."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]


def latest_billing(tables: Tables) -> DataFrame:
    """The billing row with the highest application number of each project.

    ``rank() = 1`` keeps ties, as a self-join on the maximum would, in one scan;
    Spark drops the other rows of a project before the exchange (window group limit).
    """
    newest = Window.partitionBy("project_id").orderBy(F.desc("application_number"))
    return (
        tables["billing_history"]
        .withColumn("recency", F.rank().over(newest))
        .where(F.col("recency") == 1)
        .drop("recency")
    )


def latest_billing_one(tables: Tables, project_id: str) -> DataFrame:
    """One project's newest billing row."""
    return (
        tables["billing_history"]
        .where(F.col("project_id") == project_id)
        .orderBy(F.desc("application_number"))
        .limit(1)
    )
