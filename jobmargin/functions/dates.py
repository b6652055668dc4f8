"""Date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_end_sunday(date: Column | str) -> Column:
    """The Sunday that ends the Monday-to-Sunday week of a date."""
    value = F.col(date) if isinstance(date, str) else date
    return F.date_add(value, F.lit(6) - F.weekday(value))
