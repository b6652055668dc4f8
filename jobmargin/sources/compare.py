"""What changed between two loads of a table, found through a tree of digests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmargin.session import materialise

FAN, DEPTH = 4, 4      # bits a level, and levels: 65,536 leaves
DIGEST = "leaf int, n bigint, mixed bigint, total decimal(38,0)"


def leaf_of(keys: Sequence[str]) -> Column:
    """The leading bits of the key's hash: a range of hashes, so each level of the tree is a prefix of the next."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FAN * DEPTH).cast("int")


def row_hash(columns: Sequence[str]) -> Column:
    """Of the whole row.  Which columns are null counts too, as a hash alone passes nulls over."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(nulls, *columns)


def load_digests(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(leaf, n, mixed, total): count, exclusive or and sum of the row hashes of each leaf, in one scan, map-side first.

    Written beside a load, they spare reading it again for a comparison.  Repeated rows count.
    """
    columns = sorted(rows.columns)
    hashed = rows.select(leaf_of(keys).alias("leaf"), row_hash(columns).alias("h"))
    return hashed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("mixed"), F.sum(F.col("h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"))


def _lifted(digests: DataFrame) -> DataFrame:
    """Digests of the parents, from those of their children."""
    return digests.groupBy(F.shiftright("leaf", FAN).alias("leaf")).agg(
        F.sum("n").alias("n"), F.bit_xor("mixed").alias("mixed"), F.sum("total").cast("decimal(38,0)").alias("total"))


def _unequal(before: DataFrame, after: DataFrame) -> DataFrame:
    other = after.select("leaf", *[F.col(c).alias(f"{c}_after") for c in ("n", "mixed", "total")])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_after")) for c in ("n", "mixed", "total")])
    return before.join(other, "leaf", "full").where(~same).select("leaf")


def differing_leaves(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaves whose digests differ, found from the root down: below a node that agrees nothing is looked at."""
    levels = [(before, after)]
    for _ in range(DEPTH - 1):
        levels.append(tuple(map(_lifted, levels[-1])))
    wanted = None
    for left, right in reversed(levels):
        if wanted is not None:
            inside = wanted.select(F.col("leaf").alias("parent"))
            left, right = (d.join(inside, F.shiftright("leaf", FAN) == F.col("parent"), "left_semi") for d in (left, right))
        wanted = _unequal(left, right)
    return wanted


def compare_loads(before: DataFrame, after: DataFrame, keys: Sequence[str],
                  digests: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Keys that were inserted, deleted or changed from one load to the other: the keys, and `change` (eager).

    Only rows of leaves that differ are compared, by key; null keys are a key.  `digests` are those
    of both loads, if stored.  Columns must be the same.  A key that repeats in a load is changed where
    the rows of the two loads, counted with their repeats, differ.
    """
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError("Both loads need the same columns.")
    digests = digests or tuple(materialise(load_digests(rows, keys), "load-digests") for rows in (before, after))
    leaves = materialise(differing_leaves(*digests), "differing-leaves")
    columns = sorted(before.columns)

    def candidates(rows: DataFrame, side: str) -> DataFrame:
        inside = rows.withColumn("leaf", leaf_of(keys)).join(leaves, "leaf", "left_semi")
        return inside.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(row_hash(columns)).alias("mixed"),
            F.sum(row_hash(columns).cast("decimal(38,0)")).alias("total"),
        ).withColumn("side", F.lit(side))

    both = candidates(before, "before").unionByName(candidates(after, "after"))
    content = F.collect_set(F.struct("n", "mixed", "total"))
    sides = both.groupBy(*keys).agg(F.collect_set("side").alias("sides"), F.size(content).alias("contents"))
    change = (
        F.when(~F.array_contains("sides", "before"), "inserted").when(~F.array_contains("sides", "after"), "deleted")
        .when(F.col("contents") > 1, "changed")
    )
    return sides.select(*keys, change.alias("change")).where(F.col("change").isNotNull())
