"""Ad-hoc SELECT over the portfolio tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

ONLY_SELECT = re.compile(r"^SELECT\b", re.IGNORECASE)


def select_sql(spark: SparkSession, tables: Mapping[str, DataFrame], query: str,
               names: tuple[str, ...] | None = None) -> DataFrame:
    """Run one SELECT with the tables visible under their names.

    One trailing semicolon is dropped; anything that does not start with SELECT is
    refused, WITH included.  The result is lazy.  The names are bound while the statement
    is analysed; the session's own views of these names are as before afterwards.
    """
    text = query.strip()
    text = text[:-1] if text.endswith(";") else text
    if not ONLY_SELECT.match(text):
        raise ValueError("Only SELECT queries are allowed.")
    visible = list(names or tables)
    own = {name: spark.table(name) for name in visible if spark.catalog.tableExists(name)}
    try:
        for name in visible:
            tables[name].createOrReplaceTempView(name)
        return spark.sql(text)
    finally:
        for name in visible:
            spark.catalog.dropTempView(name)
            if name in own and not spark.catalog.tableExists(name):
                own[name].createOrReplaceTempView(name)
