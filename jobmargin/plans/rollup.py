"""Labor entries rolled up over portfolio, contract, line and week."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmargin.functions import measures as m
from jobmargin.functions.dates import week_end_sunday
from jobmargin.plans import earned_value as ev
from jobmargin.session import materialise, parts_by_input

Tables = Mapping[str, DataFrame]

LEVELS = ("portfolio", "contract", "line", "week")
BUCKETS = 256
BLOCK = 16             # edges of buckets in a block; each entry is compared with the blocks' and with those of one
ACCURACY = 10_000
GROUP = ["level", "project", "line", "week"]


def _groups(rows: DataFrame) -> DataFrame:
    """Each row once for each level, as (level, project, line, week) with empty text above a level."""
    keys = [F.col("project_id"), F.col("sov_line_id"), F.col("week_end").cast("string")]
    each = [
        F.struct(F.lit(level).alias("level"), *[(key if k < level else F.lit("")).alias(name) for k, (key, name) in enumerate(zip(keys, GROUP[1:]))])
        for level in range(len(LEVELS))
    ]
    return rows.select("*", F.inline(F.array(*each)))


def _bucket(edges: list, kind: T.DataType) -> Column:
    """How many of the sorted edges are at or below entry_cost, none below null: found among blocks of edges, then in one block."""
    blocks = [edges[i:i + BLOCK] for i in range(0, len(edges), BLOCK)] or [[]]

    def array(values):
        return F.array(*[F.lit(v) for v in values]).cast(T.ArrayType(kind))

    def reached(values):
        return F.size(F.filter(values, lambda edge: edge <= F.col("entry_cost")))

    block = reached(array([own[0] for own in blocks[1:]]))
    return block * BLOCK + reached(F.element_at(F.array(*map(array, blocks)), block + 1))


def _middle_values(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """Values, with their copies, of the middle buckets that hold several; `below` counts what lies under the bucket.

    Values are dealt to their groups only where their project has such a bucket; of the portfolio, there are two at most.
    """
    ends = F.array(*[F.struct(F.col(f"{end}_bucket").alias("bucket"), F.col(f"{end}_below").alias("below")) for end in ("low", "high")])
    wide = groups.select(*GROUP, "n", F.explode(F.array_distinct(ends)).alias("end")).select(*GROUP, "n", "end.*").where("bucket IS NOT NULL")
    costs = placed.where(F.col("entry_cost").isNotNull()).select(*ev.LINE_WEEK, "entry_cost", "copies", "bucket")
    top = F.broadcast(wide.where("level = 0"))
    above = costs.select("bucket", "entry_cost", "copies").join(top, "bucket").select(*GROUP, "bucket", "n", "below", "entry_cost", "copies")
    wide = wide.where("level > 0")
    near = costs.join(wide.select(F.col("project").alias("project_id"), "bucket").distinct(), ["project_id", "bucket"], "left_semi")
    dealt = _groups(near).where("level > 0").join(wide, [*GROUP, "bucket"])
    rows = dealt.select(*above.columns).unionByName(above)
    return rows.groupBy(*GROUP, "bucket", "n", "below", "entry_cost").agg(F.sum("copies").alias("copies"))


def labor_rollup(tables: Tables) -> DataFrame:
    """Entries, hours, cost and the exact median cost of an entry at every level of the hierarchy (eager).

    Entries are shuffled once: they are counted by line, week and cost, map-side first, and what that leaves is written.
    All levels are made of these counts.  One set of cost buckets, cut by a sketch of all costs, serves every
    group: counts by group and bucket add up over levels and tell in which bucket a group's middle lies.
    A middle bucket of one value gives that value; only values of the others are put in order.  The counts are
    exact, so the medians are, wherever the buckets are cut, and no group of any size is sorted in one task.
    """
    entries = tables["labor_logs"].select(
        *ev.LINE, week_end_sunday("date").alias("week_end"), m.labor_cost().alias("entry_cost"), m.labor_hours().alias("entry_hours"))
    counted = materialise(
        entries.groupBy(*ev.LINE_WEEK, "entry_cost").agg(F.count(F.lit(1)).alias("copies"), F.sum("entry_hours").alias("hours")), "labor-counts")
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = counted.agg(F.percentile_approx("entry_cost", shares, ACCURACY)).first()[0] or []
    placed = counted.withColumn("bucket", _bucket(sorted(set(cuts)), counted.schema["entry_cost"].dataType))

    totals = _groups(placed).groupBy(*GROUP, "bucket").agg(
        F.sum("copies").alias("entries"),
        F.sum(F.when(F.col("entry_cost").isNotNull(), F.col("copies"))).alias("valued"),
        F.sum("hours").alias("hours"), F.sum(F.col("entry_cost") * F.col("copies")).alias("cost"),
        F.min("entry_cost").alias("least"), F.max("entry_cost").alias("most"),
    )
    # Sorted with all their sums, so their partitions follow the input and not what is shuffled.
    parts = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = totals.repartition(max(parts, parts_by_input(tables["labor_logs"], ev.SHARE)), *GROUP)
    whole, by_bucket = Window.partitionBy(*GROUP), Window.partitionBy(*GROUP).orderBy("bucket")
    ranked = totals.withColumns({"n": F.sum("valued").over(whole), "until": F.sum("valued").over(by_bucket)})
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    below, known = F.col("until") - F.col("valued"), F.col("least") == F.col("most")

    def holds(rank):
        return (below < rank) & (rank <= F.col("until"))

    middle = {f"{end}_{name}": F.max(F.when(holds(rank) & own, value)) for end, rank in (("low", lower), ("high", upper))
              for name, own, value in (("cost", known, m.dbl("least")), ("bucket", ~known, F.col("bucket")), ("below", ~known, below))}
    groups = materialise(ranked.groupBy(*GROUP).agg(
        F.sum("entries").alias("entries"), F.sum("hours").alias("hours"), F.sum("cost").alias("cost"), F.max("n").alias("n"),
        *[value.alias(name) for name, value in middle.items()]), "labor-groups")

    values = _middle_values(placed, groups)
    inside = Window.partitionBy(*GROUP, "bucket").orderBy("entry_cost")
    values = values.withColumn("until", F.col("below") + F.sum("copies").over(inside))

    def at(rank):
        return F.max(F.when((F.col("until") - F.col("copies") < rank) & (rank <= F.col("until")), m.dbl("entry_cost")))

    medians = values.groupBy(*GROUP).agg(at(lower).alias("low"), at(upper).alias("high"))
    # As in the join, a group with a null key has no median.
    keyed = F.concat(*GROUP[1:]).isNotNull()
    sums = groups.join(medians, GROUP, "left").withColumns({
        end: F.coalesce(end, F.when(keyed, F.col(f"{end}_cost"))) for end in ("low", "high")})
    names = F.array(*[F.lit(name) for name in LEVELS])
    return sums.select(
        names[F.col("level")].alias("level"), *[F.nullif(F.col(g), F.lit("")).alias(c) for g, c in (("project", "project_id"), ("line", "sov_line_id"))],
        F.nullif(F.col("week"), F.lit("")).cast("date").alias("week_end"), "entries", m.dbl("hours").alias("hours"), m.dbl("cost").alias("cost"),
        (F.col("low") + (F.col("high") - F.col("low")) * 0.5).alias("median_cost"),
    )
