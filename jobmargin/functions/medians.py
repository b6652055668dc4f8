"""Exact medians for a few groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
BUCKETS = 256


def median_of_large_groups(df: DataFrame, group: str, value: str, output: str) -> DataFrame:
    """(group, output): the exact interpolated median of the non-NULL values per group.

    The built-in ``median`` keeps a group's distinct values in one task.  Here a mergeable
    quantile sketch cuts each group at many edges, values are counted by bucket, and only
    the buckets that hold the middle, a small and even share of the group, are put in
    order.  The counts are exact, so the result is exact wherever the edges lie.
    """
    present = df.select(group, value).where(F.col(value).isNotNull())
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    edges = present.groupBy(group).agg(
        F.percentile_approx(value, shares, SKETCH_ACCURACY).alias("edges"), F.count(F.lit(1)).alias("n"),
    ).withColumnRenamed(group, "edge_group")
    counted = (
        present.groupBy(group, value).agg(F.count(F.lit(1)).alias("copies"))
        .join(edges, F.col(group).eqNullSafe(F.col("edge_group")))
        .withColumn("bucket", F.size(F.filter("edges", lambda edge: edge <= F.col(value))))
        .select(group, value, "copies", "n", "bucket")
    )
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1

    in_group = Window.partitionBy(group).orderBy("bucket")
    totals = counted.groupBy(group, "n", "bucket").agg(F.sum("copies").alias("in_bucket"))
    reached = totals.withColumn("until", F.sum("in_bucket").over(in_group))  # BUCKETS rows a group at most
    middle = reached.where((F.col("until") >= lower) & (F.col("until") - F.col("in_bucket") < upper)).select(
        F.col(group).alias("middle_group"), F.col("bucket").alias("middle_bucket"),
        (F.col("until") - F.col("in_bucket")).alias("below"),
    )
    here = F.col(group).eqNullSafe(F.col("middle_group")) & (F.col("bucket") == F.col("middle_bucket"))
    in_bucket = Window.partitionBy(group, "bucket").orderBy(value)
    last_rank = F.col("below") + F.sum("copies").over(in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.join(middle, here).withColumn("last_rank", last_rank)

    def at(rank):
        hit = (F.col("last_rank") - F.col("copies") < rank) & (rank <= F.col("last_rank"))
        return F.max(F.when(hit, F.col(value)))

    middles = ranked.groupBy(group).agg(at(lower).alias("lo"), at(upper).alias("hi"))
    return middles.select(group, (F.col("lo") + (F.col("hi") - F.col("lo")) * 0.5).alias(output))
