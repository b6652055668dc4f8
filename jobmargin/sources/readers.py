"""Typed readers: CSV exports and Parquet copies of the portfolio tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmargin.sources.schemas import FILE_TABLES, TABLES, Table


def empty_to_null(column: Column) -> Column:
    """Empty text is a missing value; blanks are kept as they are."""
    return F.nullif(column, F.lit(""))


def text_to_bool(column: Column) -> Column:
    """'true' in any case or '1' is true; anything else, also missing, is false."""
    return F.coalesce(F.lower(column).isin("true", "1"), F.lit(False))


def typed_column(raw: Column, data_type: T.DataType) -> Column:
    """Text to its declared type.  A number or date that does not parse fails the load (ANSI cast)."""
    if isinstance(data_type, T.BooleanType):
        return text_to_bool(raw)
    if isinstance(data_type, T.StringType):
        return empty_to_null(raw)
    return empty_to_null(raw).cast(data_type)


def checked(column: Column, table: Table, declared, strict: bool) -> Column:
    """The column; in strict loads a missing required value fails the load."""
    if not (strict and declared.required):
        return column.alias(declared.name)
    message = F.lit(f"{table.name}.{declared.name} is required")
    failed = F.raise_error(message).cast(declared.type)
    return F.when(column.isNull(), failed).otherwise(column).alias(declared.name)


def require_columns(raw: DataFrame, table: Table) -> None:
    missing = [c.name for c in table.columns if c.required and c.name not in raw.columns]
    if missing:
        raise ValueError(f"{table.name} lacks required columns: {', '.join(missing)}")


def normalise(raw: DataFrame, table: Table, extra: Iterable[str] = (), strict: bool = True) -> DataFrame:
    """All-text rows to the declared schema, matched by column name.

    In strict loads a missing required column or value is an error; other columns that the
    input lacks become NULL.  ``extra`` names text columns to carry along beside the schema.
    """
    if strict:
        require_columns(raw, table)

    def source(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    typed = [checked(typed_column(source(c.name), c.type), table, c, strict) for c in table.columns]
    carried = [empty_to_null(source(name)).alias(name) for name in extra]
    return raw.select(*typed, *carried)


def conform(raw: DataFrame, table: Table, extra: Iterable[str] = (), strict: bool = True) -> DataFrame:
    """Typed rows cast to the declared schema under the same checks; wider decimals keep their digits before the point."""
    if strict:
        require_columns(raw, table)

    def source(declared) -> Column:
        if declared.name not in raw.columns:
            return F.lit(None).cast(declared.type)
        own, wanted = raw.schema[declared.name].dataType, declared.type
        if isinstance(wanted, T.DecimalType) and isinstance(own, T.DecimalType):
            whole = max(own.precision - own.scale, wanted.precision - wanted.scale)
            wanted = T.DecimalType(min(38, whole + wanted.scale), wanted.scale)
        return F.col(declared.name).cast(wanted)

    typed = [checked(source(c), table, c, strict) for c in table.columns]
    return raw.select(*typed, *[F.col(name) for name in extra if name in raw.columns])


def read_csv_table(spark: SparkSession, path: str, name: str, multi_line: bool | None = None,
                   strict: bool = True) -> DataFrame:
    """One table from CSV with a header row.

    Quoted line breaks need ``multiLine``, which reads a file in one task, so it is
    on only for tables with free text unless the caller decides.  Large exports
    should be many files, or Parquet.
    """
    table = TABLES[name]
    raw = spark.read.csv(
        path,
        header=True,
        inferSchema=False,
        multiLine=table.free_text if multi_line is None else multi_line,
        quote='"',
        escape='"',
        mode="FAILFAST",
    )
    extra = ("affected_sov_lines",) if name == "change_orders" else ()
    return normalise(raw, table, extra, strict)


def load_tables(spark: SparkSession, folder: str, names: Iterable[str] = FILE_TABLES,
                fmt: str = "csv", strict: bool = True) -> dict[str, DataFrame]:
    """The file tables of a folder, plus the junction derived from change orders.

    Whatever the format, rows come out in the declared types; unless ``strict`` is off, a
    load fails on a missing required column or value.
    """
    from jobmargin.sources.junction import co_sov_lines

    folder = folder.rstrip("/")
    if fmt == "csv":
        tables = {name: read_csv_table(spark, f"{folder}/{name}.csv", name, strict=strict) for name in names}
    else:
        tables = {
            name: conform(spark.read.format(fmt).load(f"{folder}/{name}"), TABLES[name], ("affected_sov_lines",), strict)
            for name in names
        }
    if "change_orders" in tables and "change_order_sov_lines" not in tables:
        tables["change_order_sov_lines"] = co_sov_lines(tables)
    return tables
