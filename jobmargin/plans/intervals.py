"""Joins of dated rows with the periods that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKS = 13             # of a bucket
HOT = 100_000          # dated rows of one key and bucket from which it is split


def week_number(date: Column | str) -> Column:
    """Whole weeks, Monday to Sunday, since the one of 1970-01-01."""
    value = F.col(date) if isinstance(date, str) else date
    return F.floor((F.unix_date(value) + 3) / 7).cast("int")


def join_in_periods(dated: DataFrame, periods: DataFrame, keys: Sequence[str], at: str, start: str, end: str,
                    unique: str, weeks: int = WEEKS, hot: int = HOT) -> DataFrame:
    """Each row of `dated` with each period of its key that holds its date, both ends included.

    A period has a copy in every bucket of `weeks` weeks that it touches and a dated row is in one, so
    they meet by equality of key and bucket and the dates are compared afterwards; no pair is found twice.
    Keys and buckets with more than `hot` dated rows are split in as many parts by a hash of
    `unique`, and their periods copied to each part; the list of these has at most a row for `hot`
    rows.  Null dates, null ends and null keys join nothing.
    """
    place = [*keys, "bucket"]
    points = dated.withColumn("bucket", F.floor(week_number(at) / weeks))
    counts = points.where(F.col(at).isNotNull()).groupBy(*place).agg(F.count(F.lit(1)).alias("n_dated"))
    split = counts.where(F.col("n_dated") > hot).select(*place, F.ceil(F.col("n_dated") / hot).cast("int").alias("parts"))
    points = points.join(split, place, "left").withColumn(
        "part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(unique), F.col("parts")).cast("int")))
    touched = F.sequence(F.floor(week_number(start) / weeks), F.floor(week_number(end) / weeks))
    copies = periods.where(F.col(start) <= F.col(end)).withColumn("bucket", F.explode(touched))
    copies = copies.join(split, place, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = points.drop("parts").join(copies.drop("parts"), [*place, "part"])
    return met.where(F.col(at).between(F.col(start), F.col(end))).drop("bucket", "part")


def as_of_join(rows: DataFrame, states: DataFrame, keys: Sequence[str], at: str, since: str, tie: str) -> DataFrame:
    """Each of `rows` with the state in force at its date: the last one of its key with `since` on or before `at`.

    Rows and states are stacked and shuffled once by key; a running last value carries each state
    to the rows behind it, so neither side is repeated.  Of states since the same date the highest
    `tie` counts.  Rows before the first state, and rows without date, keep nulls; states without date never hold.
    """
    columns = [c for c in states.columns if c not in keys]
    left = rows.select(*keys, F.col(at).alias("as_of"), F.lit(1).alias("kind"), F.struct(*rows.columns).alias("row"))
    right = states.where(F.col(since).isNotNull()).select(
        *keys, F.col(since).alias("as_of"), F.lit(0).alias("kind"), F.struct(*columns).alias("state"))
    order = Window.partitionBy(*keys).orderBy(F.col("as_of").asc_nulls_first(), "kind", f"state.{tie}")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = left.unionByName(right, allowMissingColumns=True)
    met = stacked.withColumn("state", F.last("state", ignorenulls=True).over(running)).where(F.col("kind") == 1)
    return met.select("row.*", *[F.col(f"state.{c}").alias(c) for c in columns])
