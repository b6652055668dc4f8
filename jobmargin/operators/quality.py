"""Data-quality reports: keys, references, domains and business rules.

Each report has a row per rule (or project) also where nothing is wrong.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.sources.schemas import DOMAINS, REFERENCES, TABLES, Reference

Tables = Mapping[str, DataFrame]

LABELS = ("child_table", "columns", "parent_table")


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def dq_primary_key(tables: Tables, names: Iterable[str] = tuple(TABLES)) -> DataFrame:
    """Per table: rows, keys that occur more than once, and rows beyond the first of a key."""
    def report(name: str) -> DataFrame:
        copies = tables[name].groupBy(*TABLES[name].key).agg(F.count(F.lit(1)).alias("n"))
        return copies.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.count_if(F.col("n") > 1).alias("duplicate_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        ).select(F.lit(name).alias("table_name"), "*")

    return _union(map(report, names))


def dq_foreign_key(tables: Tables, references: Iterable[Reference] = REFERENCES) -> DataFrame:
    """Per reference: key values without a parent and the rows holding them.

    Each child is scanned once: its rows are counted by all its key columns, map-side first, and the counts
    are then dealt to its references.  All references meet the stacked parent keys in one anti join, where
    a key that fills a third of a table is one row.  A key with a NULL part refers to nothing.
    """
    references = list(references)
    targets = list(dict.fromkeys((ref.parent, ref.parent_columns) for ref in references))
    names = [f"key_{k}" for k in range(max(len(ref.columns) for ref in references))]

    def keys(columns: tuple[str, ...]) -> list[Column]:
        padded = [F.col(c).cast("string") for c in columns] + [F.lit("")] * (len(names) - len(columns))
        return [value.alias(name) for value, name in zip(padded, names)]

    def dealt(child: str) -> DataFrame:
        own = [(number, ref) for number, ref in enumerate(references) if ref.child == child]
        columns = list(dict.fromkeys(c for _, ref in own for c in ref.columns))
        counted = tables[child].groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        each = [
            F.struct(F.lit(number).alias("reference"), F.lit(targets.index((ref.parent, ref.parent_columns))).alias("target"), *keys(ref.columns))
            for number, ref in own
        ]
        return counted.select("n", F.inline(F.array(*each)))

    children = _union(map(dealt, dict.fromkeys(ref.child for ref in references))).dropna(subset=names)
    counts = children.groupBy("reference", "target", *names).agg(F.sum("n").alias("n"))
    parents = _union(
        tables[parent].select(F.lit(number).alias("target"), *keys(columns)) for number, (parent, columns) in enumerate(targets))
    orphans = counts.join(parents, ["target", *names], "left_anti").groupBy("reference").agg(
        F.count(F.lit(1)).alias("orphan_keys"), F.sum("n").alias("orphan_rows"))

    # One row per reference, also for those without orphans.
    listed = F.array(*[
        F.struct(F.lit(number).alias("reference"), F.lit(ref.child).alias("child_table"),
                 F.lit(",".join(ref.columns)).alias("columns"), F.lit(ref.parent).alias("parent_table"))
        for number, ref in enumerate(references)
    ])
    rows = tables[references[0].child].sparkSession.range(1).select(F.inline(listed))
    return rows.join(orphans, "reference", "left").select(
        *LABELS, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("orphan_keys", "orphan_rows")])


def dq_domain(tables: Tables) -> DataFrame:
    """Values outside their declared list, with row counts; one pass per table."""
    def report(name: str) -> DataFrame:
        bad = [
            F.when(~F.col(column).isin(*allowed),
                   F.struct(F.lit(column).alias("column_name"), F.col(column).alias("value")))
            for (table, column), allowed in DOMAINS.items() if table == name
        ]
        return (
            tables[name]
            .select(F.explode(F.array_compact(F.array(*bad))).alias("bad"))
            .groupBy("bad.column_name", "bad.value")
            .agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.lit(name).alias("table_name"), "column_name", "value", "row_count")
        )

    return _union(report(name) for name in dict.fromkeys(table for table, _ in DOMAINS))


def dq_not_null(tables: Tables, names: Iterable[str] = tuple(TABLES)) -> DataFrame:
    """Per required column: NULL rows; one pass per table."""
    def report(name: str) -> DataFrame:
        required = [c.name for c in TABLES[name].columns if c.required]
        counts = tables[name].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        return counts.unpivot([], required, "column_name", "null_rows").select(
            F.lit(name).alias("table_name"), "column_name", "null_rows"
        )

    return _union(map(report, names))


def dq_length(tables: Tables, names: Iterable[str] = tuple(TABLES)) -> DataFrame:
    """Per text column with a declared length: rows over it and the longest text."""
    def report(name: str) -> DataFrame:
        limited = [c for c in TABLES[name].columns if c.length is not None]
        stats = tables[name].agg(*[
            F.struct(
                F.lit(c.name).alias("column_name"),
                F.lit(c.length).cast("bigint").alias("declared_length"),
                F.count_if(F.length(c.name) > c.length).alias("rows_over"),
                F.max(F.length(c.name)).cast("bigint").alias("longest"),
            ).alias(c.name)
            for c in limited
        ])
        return stats.select(F.inline(F.array(*[F.col(c.name) for c in limited]))).select(
            F.lit(name).alias("table_name"), "*"
        )

    return _union(map(report, names))


def dq_sov_sum(tables: Tables) -> DataFrame:
    """Per project: contract value against the sum of its SOV values."""
    sums = tables["sov"].groupBy("project_id").agg(F.sum("scheduled_value").alias("sov_total"))
    rows = tables["contracts"].select("project_id", "original_contract_value").join(
        sums, "project_id", "left")
    value, total = F.col("original_contract_value"), m.zero_if_null("sov_total")
    return rows.select(
        "project_id",
        m.dbl(value).alias("contract_value"),
        m.dbl(total).alias("sov_total"),
        m.dbl(value - total).alias("difference"),
        (value == total).alias("ok"),
    )


def dq_billing_cap(tables: Tables) -> DataFrame:
    """Per project: billing lines, those billed beyond their scheduled value, and the largest excess."""
    excess = F.col("total_billed") - F.col("scheduled_value")
    return tables["billing_line_items"].groupBy("project_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(excess > 0).alias("lines_over"),
        m.dbl(F.max(excess)).alias("largest_excess"),
    )


def dq_billing_cumulative(tables: Tables) -> DataFrame:
    """Per project: applications whose cumulative amount is not the running sum of the periods."""
    running = (
        Window.partitionBy("project_id").orderBy("application_number")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = tables["billing_history"].select(
        "project_id", "application_number", "cumulative_billed",
        F.sum("period_total").over(running).alias("running_total"),
    )
    return rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("applications"),
        F.count_if(F.col("cumulative_billed") != F.col("running_total")).alias("mismatches"),
    )


def dq_cost_code(tables: Tables) -> DataFrame:
    """Per project: labor rows whose cost code is not the line number of their SOV line, and rows of unknown lines."""
    codes = tables["labor_logs"].groupBy("project_id", "sov_line_id", "cost_code").agg(
        F.count(F.lit(1)).alias("n"))
    sov = tables["sov"].select("sov_line_id", "line_number")
    wrong, unknown = F.col("cost_code") != F.col("line_number"), F.col("known").isNull()
    return codes.join(sov.withColumn("known", F.lit(True)), "sov_line_id", "left").groupBy("project_id").agg(
        F.sum("n").alias("labor_rows"),
        F.coalesce(F.sum(F.when(wrong, F.col("n"))), F.lit(0)).alias("wrong_rows"),
        F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)).alias("unknown_line_rows"),
    )
