"""Writers for tables and weekly facts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from jobmargin.sources.schemas import TABLES


def write_table(df: DataFrame, path: str, fmt: str = "parquet", cluster_by: Iterable[str] = ("project_id",),
                partition_by: Iterable[str] = (), mode: str = "overwrite", **options: object) -> None:
    """Write one table.

    By default rows are range-clustered by project and then sorted, so a filter on
    project prunes files and row groups by their min/max statistics.  The caller
    appends a unique key to ``cluster_by`` to let a very large project span several
    files.  Folder partitioning (``partition_by``) is for portfolios with few
    projects; with many it makes too many small files.
    """
    columns = [c for c in cluster_by if c in df.columns]
    if columns:
        df = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    writer = df.write.mode(mode).options(**options)
    if tuple(partition_by):
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, names: Iterable[str] | None = None,
                 fmt: str = "parquet", **options: object) -> None:
    """Write several tables below one folder, each clustered by project and its own key."""
    for name in names if names is not None else tables:
        key = TABLES[name].key if name in TABLES else ()
        cluster = ("project_id", *(k for k in key if k != "project_id"))
        write_table(tables[name], f"{folder.rstrip('/')}/{name}", fmt, cluster, **options)


def write_csv_table(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write CSV in the form the typed reader expects: header, doubled quotes, empty for NULL.

    Text of numbers and repeated keys is several times larger than the rows it holds, so files are compressed
    by default; a file is read in one task, and there are as many as partitions.
    """
    df.write.mode("overwrite").option("zlib.compress.level", "FOUR").csv(
        path, header=True, quote='"', escape='"', nullValue="", emptyValue="",
        dateFormat="yyyy-MM-dd", compression=compression,
    )


def write_facts(facts: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Write the weekly, closeout and project-week facts below one folder."""
    for name, df in facts.items():
        path = f"{folder.rstrip('/')}/{name}"
        if fmt == "csv":
            write_csv_table(df, path)
        else:
            write_table(df, path, fmt, ("project_id", "sov_line_id", "week_end"))


def read_fact_week(spark, path: str, like: DataFrame, fmt: str = "csv") -> DataFrame:
    """Read a written fact back with the types of ``like``; empty text stays empty, not NULL."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    frame = spark.read.schema(like.schema).csv(
        path, header=True, quote='"', escape='"', mode="FAILFAST", dateFormat="yyyy-MM-dd"
    )
    return frame.fillna("", subset=[c for c in ("description",) if c in frame.columns])
