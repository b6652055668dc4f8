"""Every operator as a query over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmargin.functions import measures as m
from jobmargin.functions.dates import week_end_sunday
from jobmargin.operators import (
    adhoc, alerts, billing, changes, labor, margin, notes, portfolio, quality, scope,
)
from jobmargin.plans import earned_value as ev
from jobmargin.plans import drift, incremental, latest, leaks, ledger, rollup
from jobmargin.session import materialise, parts_by_input, shared_folder, written_step
from jobmargin.sources import compare, junction, note_index, readers, writers
from jobmargin.sources.bridge import BridgeTables, bridge
from jobmargin.sources.schemas import FILE_TABLES, TABLES
from jobmargin.streaming import labor as stream_labor
from jobmargin.streaming import overruns as stream_overruns
from jobmargin.streaming import lag as billing_lags
from jobmargin.streaming.runner import appended, result_of

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered filters and searches.
PROJECT = "PRJ-000001"
SEARCH = "rewh"
NOTE_TYPE = "Issue Log"
WORDS = ("the", "rewh")
CAUSES = ("rewh", "ononst")
WEEK_STARTS = ("1998-06-01", "1998-06-08", "1998-06-15")   # Mondays on which increments of the weekly facts begin
ADDED_FROM = "1999-07-01"   # notes from here on are added to the index afterwards
SQL = """SELECT c.gc_name, SUM(m.total_cost) AS total_cost FROM material_deliveries m
    JOIN contracts c ON c.project_id = m.project_id GROUP BY c.gc_name;"""


def portable(df: DataFrame) -> DataFrame:
    """Decimals as double, all doubles rounded to 6 places, all integers as bigint."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double") if field.dataType.scale <= 6 else F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def over_tables(operator: Callable[..., DataFrame], **params: object) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return portable(operator(bridge(spark, folder), **params))

    query.__doc__ = operator.__doc__
    return query


def as_text(df: DataFrame) -> DataFrame:
    """All columns as CSV would hold them: text, empty where NULL."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


# --- sources and sinks -------------------------------------------------------------------

# The bridge leaves some required reasons empty, for the quality reports to find.
CHECKSUM_PRIME = 1_000_003


def checksum(name: str, data_type: T.DataType) -> Column:
    """Sum over a column's values, each as a number; another value or type changes it."""
    column = F.col(name)
    if isinstance(data_type, T.StringType):
        number = F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("bigint")
    elif isinstance(data_type, T.DateType):
        number = F.unix_date(column).cast("bigint")
    elif isinstance(data_type, T.DecimalType):
        number = F.pmod((column * 10000).cast("bigint"), F.lit(CHECKSUM_PRIME))
    else:
        number = F.pmod(column.cast("bigint"), F.lit(CHECKSUM_PRIME))
    return F.coalesce(F.sum(number), F.lit(0))


def profile(tables: Mapping[str, DataFrame], names: Iterable[str]) -> DataFrame:
    """(table_name, column_name, data_type, row_count, filled, checksum) of every declared column, from one pass over each table."""
    reports = []
    for name in names:
        df = tables[name]
        columns = F.array(*[
            F.struct(
                F.lit(c.name).alias("column_name"), F.lit(kind_of(df.schema[c.name].dataType)).alias("data_type"),
                F.count(c.name).alias("filled"), checksum(c.name, df.schema[c.name].dataType).alias("checksum"),
            ) for c in TABLES[name].columns
        ])
        totals = df.agg(F.count(F.lit(1)).alias("row_count"), columns.alias("columns"))
        reports.append(totals.select(F.lit(name).alias("table_name"), "row_count", F.inline("columns")))
    return portable(ledger.stack(reports))


def kind_of(data_type: T.DataType) -> str:
    """The type's name; of decimals, the scale, as sums widen the digits before the point."""
    return f"decimal scale {data_type.scale}" if isinstance(data_type, T.DecimalType) else data_type.simpleString()


def load_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All file tables written as CSV and loaded typed, with the junction: a profile of every column."""
    tables = bridge(spark, folder)
    path = shared_folder(spark, "load-tables")
    for name in FILE_TABLES:
        writers.write_csv_table(tables[name], f"{path}/{name}.csv")
    return profile(readers.load_tables(spark, path, strict=False), TABLES)


def _normalised(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every table as text and typed again."""
    tables = bridge(spark, folder)
    extra = {"change_orders": ("affected_sov_lines",)}
    return {
        name: readers.normalise(as_text(tables[name]), TABLES[name], extra.get(name, ()), strict=False) for name in TABLES
    }


def normalise_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Filled and missing values of every column after empty text has become NULL."""
    report = profile(_normalised(spark, folder), TABLES)
    return report.select("table_name", "column_name", "filled", (F.col("row_count") - F.col("filled")).alias("missing"))


def normalise_bool(spark: SparkSession, folder: str) -> DataFrame:
    """Both flags from several spellings of yes and no, by priority of the RFI."""
    rfis = bridge(spark, folder)["rfis"]
    yes = F.when(F.col("priority") == "High", "1").when(F.col("priority") == "Low", "TRUE").otherwise("true")
    no = F.when(F.col("priority") == "High", "").when(F.col("priority") == "Low", "yes").otherwise(None)
    flags = [readers.text_to_bool(F.when(F.col(c), yes).otherwise(no)).alias(c) for c in ("cost_impact", "schedule_impact")]
    return rfis.select("project_id", "rfi_number", *flags)


def typed_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Declared types of every table, and the values that come through them."""
    return profile(_normalised(spark, folder), TABLES)


def write_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All tables written as Parquet clustered by project and read back: a profile of every column."""
    path = shared_folder(spark, "write-tables")
    writers.write_tables(bridge(spark, folder), path)
    return profile(readers.load_tables(spark, path, TABLES, "parquet", strict=False), TABLES)


def _written_facts(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """The named facts written and read back; several are made of one run of the weekly facts, which is written for them."""
    names, tables = list(names), bridge(spark, folder)
    earned, parts = ev.earned_value(tables), parts_by_input(tables["labor_logs"], ev.SHARE)
    if len(names) > 1:
        with written_step(spark, parts, ev.ADVISORY):
            earned = materialise(earned, "earned-value")
    plans = {
        "fact_line_week": lambda: earned.drop(*INTERNAL),
        "fact_closeout": lambda: ev.fact_closeout_from(earned), "project_week": lambda: ev.project_week_from(earned),
    }
    facts = {name: portable(plans[name]()) for name in names}
    path = shared_folder(spark, "facts")
    with written_step(spark, parts, ev.ADVISORY):
        writers.write_facts(facts, path)
    return {name: writers.read_fact_week(spark, f"{path}/{name}", fact) for name, fact in facts.items()}


def write_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The weekly, closeout and project-week facts written as CSV and read back, one below the other."""
    facts = _written_facts(spark, folder, ("fact_line_week", "fact_closeout", "project_week"))
    week, closeout, project = (df.withColumn("fact", F.lit(name)) for name, df in facts.items())
    return week.unionByName(closeout, True).unionByName(project, True)


def read_fact_week(spark: SparkSession, folder: str) -> DataFrame:
    """Project weeks computed from the written facts; money is exact again at six places."""
    fact = _written_facts(spark, folder, ("fact_line_week",))["fact_line_week"]
    amounts = [f.name for f in fact.schema.fields if isinstance(f.dataType, T.DoubleType)]
    exact = fact.withColumns({c: F.col(c).cast("decimal(28,6)") for c in amounts})
    return portable(ev.project_week_from(exact))


def load_comparison(tables: BridgeTables) -> DataFrame:
    """Two loads of the change orders: the second lacks some, has some more, and other amounts for some."""
    orders, number = tables["change_orders"], F.col("co_number")
    before = orders.where(~number.endswith("33"))
    after = orders.where(~number.endswith("77")).withColumn(
        "amount", F.when(number.endswith("55"), F.col("amount") + 1).otherwise(F.col("amount")).cast(orders.schema["amount"].dataType))
    return compare.compare_loads(before, after, ("project_id", "co_number"))


# --- measures ----------------------------------------------------------------------------

def labor_cost(tables: BridgeTables) -> DataFrame:
    return tables["labor_logs"].select("log_id", m.labor_cost().alias("labor_cost"))


def labor_hours(tables: BridgeTables) -> DataFrame:
    return tables["labor_logs"].select("log_id", m.labor_hours().alias("labor_hours"))


def bid_cost(tables: BridgeTables) -> DataFrame:
    return tables["sov_budget"].select("sov_line_id", m.bid_cost().alias("bid_cost"))


def actual_cost(tables: BridgeTables) -> DataFrame:
    return ledger.line_ledger(tables, ["labor", "material"]).select(
        "project_id", "sov_line_id", m.actual_cost().alias("actual_cost")
    )


def scope_cost(tables: BridgeTables) -> DataFrame:
    return tables["scope_creep_candidates"].select("scope_id", m.scope_cost().alias("scope_cost"))


def bid_margin(tables: BridgeTables) -> DataFrame:
    budget = tables["sov_budget"].select("sov_line_id", m.bid_cost().alias("bid_cost"))
    return tables["sov"].join(budget, "sov_line_id").select(
        "sov_line_id", m.bid_margin(F.col("scheduled_value"), F.col("bid_cost")).alias("bid_margin")
    )


def realized_margin(tables: BridgeTables) -> DataFrame:
    rows = ledger.with_contract(tables, ledger.project_ledger(tables, ["labor", "material", "billed"]))
    margin_column = m.realized_margin(m.zero_if_null("total_billed"), m.actual_cost())
    return rows.select("project_id", margin_column.alias("realized_margin"))


def margin_delta(tables: BridgeTables) -> DataFrame:
    return margin.margin_by_project(tables).select("project_id", "margin_delta")


def billing_lag(tables: BridgeTables) -> DataFrame:
    rows = ledger.with_contract(tables, ledger.project_ledger(tables, ["labor", "material", "billed"]))
    billed, cost = m.zero_if_null("total_billed"), m.actual_cost()
    return rows.select(
        "project_id", m.billing_lag(cost, billed).alias("lag"), m.billing_lag_pct(cost, billed).alias("lag_pct")
    )


def alert_message(tables: BridgeTables) -> DataFrame:
    return alerts.risk_alerts(tables).select("project_id", "type", "message")


def week_ends(tables: BridgeTables) -> DataFrame:
    """Every labor date with its week end."""
    return tables["labor_logs"].select("date", week_end_sunday("date").alias("week_end")).distinct()


def cutoff_rows(tables: BridgeTables) -> DataFrame:
    """Labor and material rows and money kept by the closeout cutoff, per project."""
    kept = ledger.stack([
        ev.closeout_cutoff(tables, "labor_logs").select(
            "project_id", F.lit(1).alias("labor"), m.labor_cost().alias("cost")),
        ev.closeout_cutoff(tables, "material_deliveries").select(
            "project_id", F.lit(1).alias("material"), F.col("total_cost").alias("cost")),
    ])
    return kept.groupBy("project_id").agg(
        F.count("labor").alias("labor_rows"), F.count("material").alias("material_rows"),
        F.sum("cost").alias("cost"),
    )


INTERNAL = ("is_closeout", "early_labor_cost_td", "early_pct_complete_td")


def public(operator: Callable[[BridgeTables], DataFrame]) -> Callable[[BridgeTables], DataFrame]:
    """An earned-value frame without its helper columns."""
    return lambda tables: operator(tables).drop(*INTERNAL)


def select_sql(spark: SparkSession, folder: str) -> DataFrame:
    return portable(adhoc.select_sql(spark, bridge(spark, folder), SQL))


def increments(tables: BridgeTables) -> list[dict[str, DataFrame]]:
    """The rows up to WEEK_STARTS[0], of each week from there, and of all later ones, as files that arrive one after the other.

    Rework of the first week comes a week late.
    """
    def number(date: str) -> Column:
        return sum(((F.col(date) >= F.lit(start)).cast("int") for start in WEEK_STARTS), F.lit(0))

    rework = F.col("log_id").startswith("OVR-") & (number("date") == 1)
    path = shared_folder(tables.spark, "arrivals")

    def written(name: str, rows: DataFrame) -> DataFrame:
        with written_step(tables.spark, parts_by_input(tables["labor_logs"], ev.SHARE)):
            rows.write.partitionBy("increment").parquet(f"{path}/{name}")
        return tables.spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    # Entries are as quickly read from their source; billing takes windows over all months and is written once, without unused amounts.
    history = written("billing_history", tables["billing_history"].select(
        "project_id", "application_number", "period_end", number("period_end").alias("increment")))
    lines = tables["billing_line_items"].select(*ev.LINE, "application_number", "description", *ev.SNAPSHOT)
    arrived = {
        "labor_logs": tables["labor_logs"].withColumn("increment", number("date") + rework.cast("int")),
        "material_deliveries": tables["material_deliveries"].withColumn("increment", number("date")),
        "billing_history": history,
        "billing_line_items": written("billing_line_items", lines.join(
            history.select("project_id", "application_number", "increment"), ["project_id", "application_number"])),
    }
    return [{name: rows.where(F.col("increment") == k) for name, rows in arrived.items()} for k in range(len(WEEK_STARTS) + 1)]


def fact_line_week_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The weekly facts with to-date columns after an initial load and three increments."""
    facts = incremental.WeeklyFacts(spark, shared_folder(spark, "weekly-facts"))
    for number, rows in enumerate(increments(bridge(spark, folder))):
        facts.append(rows, number)
    return portable(facts.read().drop(*INTERNAL))


# --- note index --------------------------------------------------------------------------

def _note_index(spark: SparkSession, notes_table: DataFrame) -> str:
    """An index of all notes: those up to a date, then the later ones added."""
    path = shared_folder(spark, "note-index")
    early = F.col("date") < ADDED_FROM
    note_index.write_note_index(notes_table.where(early), path)
    note_index.add_notes(notes_table.where(~early), path)
    return path


def field_notes_token_search(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with all WORDS, found through a written index."""
    tables = bridge(spark, folder)
    index = _note_index(spark, tables["field_notes"])
    return portable(notes.field_notes_token_search(tables, WORDS, index))


def field_note_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many notes hold each token, from the posting lists of a compacted index."""
    index = _note_index(spark, bridge(spark, folder)["field_notes"])
    note_index.compact(spark, index)
    return portable(note_index.token_counts(spark, index))


# --- streams -----------------------------------------------------------------------------

def stream_labor_week(spark: SparkSession, folder: str) -> DataFrame:
    weekly = stream_labor.stream_labor_week(stream_labor.labor_stream(spark, folder))
    return portable(result_of(weekly, ev.LINE_WEEK, "stream-labor-week"))


def _stored_budget(spark: SparkSession, folder: str) -> DataFrame:
    budget = bridge(spark, folder)["sov_budget"].groupBy("project_id").agg(
        F.sum("estimated_labor_cost").alias("estimated_labor_cost"))
    return materialise(budget, "stream-budget")


def stream_overrun_alerts(spark: SparkSession, folder: str) -> DataFrame:
    entries = stream_labor.labor_stream(spark, folder)
    running = stream_labor.stream_overrun_alerts(entries, _stored_budget(spark, folder))
    return portable(result_of(running, ["project_id"], "stream-overruns").where("open").drop("open"))


def stream_overrun_events(spark: SparkSession, folder: str) -> DataFrame:
    """Projects whose last event is an opening."""
    entries = stream_labor.labor_stream(spark, folder)
    events = stream_overruns.stream_overrun_events(entries, _stored_budget(spark, folder))
    last = result_of(events, ["project_id"], "overrun-events")
    return portable(last.where("event = 'opened'").select("project_id", "event", "reason", "budget_labor_cost"))


def labor_billing_wait(tables: BridgeTables) -> DataFrame:
    """Per project: entries billed within a month, and how long they waited."""
    return billing_lags.lag_by_project(billing_lags.billed_within(tables["labor_logs"], billing_lags.dated_applications(tables)))


def stream_labor_billing_wait(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream of entries and a stream of applications."""
    tables, path = bridge(spark, folder), shared_folder(spark, "stream-applications")
    applications = billing_lags.dated_applications(tables)
    with written_step(spark, parts_by_input(tables["labor_logs"], ev.SHARE)):
        applications.write.parquet(path)
    arriving = spark.readStream.schema(applications.schema).parquet(path)
    met = billing_lags.stream_billed_within(stream_labor.labor_stream(spark, folder), arriving)
    return portable(billing_lags.lag_by_project(appended(met, "billing-wait", closing=False)))


QUERIES: dict[str, Query] = {
    # sources, sinks, normalisation
    "load_tables": load_tables,
    "normalise_nulls": normalise_nulls,
    "normalise_bool": normalise_bool,
    "typed_schema": typed_schema,
    "write_tables": write_tables,
    "write_facts": write_facts,
    "read_fact_week": read_fact_week,
    "load_comparison": over_tables(load_comparison),
    "co_sov_lines": over_tables(junction.co_sov_lines),
    "co_impact_by_sov_line": over_tables(junction.co_impact_by_sov_line),
    # measures
    "labor_cost": over_tables(labor_cost),
    "labor_hours": over_tables(labor_hours),
    "bid_cost": over_tables(bid_cost),
    "actual_cost": over_tables(actual_cost),
    "scope_cost": over_tables(scope_cost),
    "bid_margin": over_tables(bid_margin),
    "realized_margin": over_tables(realized_margin),
    "margin_delta": over_tables(margin_delta),
    "billing_lag": over_tables(billing_lag),
    # selection
    "latest_billing": over_tables(latest.latest_billing),
    "latest_billing_one": over_tables(latest.latest_billing_one, project_id=PROJECT),
    "latest_billing_lines": over_tables(ledger.latest_billing_lines),
    "project_filter": over_tables(portfolio.project_filter, project_id=PROJECT),
    "field_notes_search": over_tables(notes.field_notes_search, search=SEARCH, note_type=NOTE_TYPE),
    "field_notes_recent": over_tables(notes.field_notes_recent),
    "field_notes_token_search": field_notes_token_search,
    "field_note_token_counts": field_note_token_counts,
    "field_note_tokens": over_tables(notes.field_note_tokens),
    "select_sql": select_sql,
    # portfolio and projects
    "portfolio_overview": over_tables(portfolio.portfolio_overview),
    "at_risk_amount": over_tables(portfolio.at_risk_amount),
    "pending_co_totals": over_tables(portfolio.pending_co_totals),
    "project_summaries": over_tables(portfolio.project_summaries),
    "project_pct_complete": over_tables(portfolio.project_pct_complete),
    "project_labor": over_tables(portfolio.project_labor),
    "project_material": over_tables(portfolio.project_material),
    "project_budget": over_tables(portfolio.project_budget),
    "project_details": over_tables(portfolio.project_details),
    "project_details_cos": over_tables(portfolio.project_details_cos),
    "project_details_scope": over_tables(portfolio.project_details_scope),
    "project_details_lines": over_tables(portfolio.project_details_lines),
    "margin_band": over_tables(portfolio.margin_bands),
    "margin_chart_data": over_tables(portfolio.margin_chart_data),
    # margin
    "margin_by_project": over_tables(margin.margin_by_project),
    "margin_by_sov_line": over_tables(margin.margin_by_sov_line),
    "margin_rank": over_tables(margin.margin_rank),
    "labor_cost_by_sov_line": over_tables(margin.labor_cost_by_sov_line),
    # billing
    "billing_lag_by_project": over_tables(billing.billing_lag_by_project),
    "billing_lag_by_sov_line": over_tables(billing.billing_lag_by_sov_line),
    "billing_lag_total": over_tables(billing.billing_lag_total),
    "labor_week_billing": over_tables(billing.labor_week_billing),
    # scope
    "scope_items": over_tables(scope.scope_items),
    "scope_summary": over_tables(scope.scope_summary),
    "scope_unbilled_hours": over_tables(scope.scope_unbilled_hours),
    "scope_recoverable": over_tables(scope.scope_recoverable),
    "scope_absorbed": over_tables(scope.scope_absorbed),
    "scope_vs_change_orders": over_tables(scope.scope_vs_change_orders),
    "rework_labor": over_tables(scope.rework_labor),
    "rework_vs_scope": over_tables(scope.rework_vs_scope),
    "scope_description": over_tables(scope.scope_description),
    # labor
    "labor_overruns": over_tables(labor.labor_overruns),
    "labor_overruns_flagged": over_tables(labor.labor_overruns_flagged),
    "labor_overrun_total": over_tables(labor.labor_overrun_total),
    "overrun_notes": over_tables(labor.overrun_notes, words=CAUSES),
    "labor_rollup": over_tables(rollup.labor_rollup),
    "overrun_periods": over_tables(labor.overrun_periods),
    "overrun_period_notes": over_tables(labor.overrun_period_notes, words=CAUSES),
    # change orders and RFIs
    "change_orders_list": over_tables(changes.change_orders_list),
    "co_status_summary": over_tables(changes.co_status_summary),
    "co_reason_summary": over_tables(changes.co_reason_summary),
    "co_summary_by_project": over_tables(changes.co_summary_by_project),
    "co_additions_credits": over_tables(changes.co_additions_credits),
    "rfi_response_days": over_tables(changes.rfi_response_days),
    "rfi_cost_exposure": over_tables(changes.rfi_cost_exposure),
    "co_with_rfi": over_tables(changes.co_with_rfi),
    # alerts
    "alert_scope_creep": over_tables(alerts.alert_scope_creep),
    "alert_labor_overrun": over_tables(alerts.alert_labor_overrun),
    "alert_billing_lag": over_tables(alerts.alert_billing_lag),
    "alert_pending_co": over_tables(alerts.alert_pending_co),
    "risk_alerts": over_tables(alerts.risk_alerts),
    "alert_message": over_tables(alert_message),
    # weekly earned value
    "week_end_sun": over_tables(week_ends),
    "closeout_cutoff": over_tables(cutoff_rows),
    "billing_week": over_tables(ev.billing_week),
    "labor_week": over_tables(ev.labor_week),
    "material_week": over_tables(ev.material_week),
    "week_spine": over_tables(ev.week_spine),
    "fact_line_week": over_tables(ev.fact_line_week),
    "fact_line_week_td": over_tables(public(ev.fact_line_week_td)),
    "fact_line_week_incremental": fact_line_week_incremental,
    "earned_value": over_tables(public(ev.earned_value)),
    "burn_signatures": over_tables(public(ev.burn_signatures)),
    "rolling_burn": over_tables(drift.rolling_burn),
    "burn_change_points": over_tables(drift.burn_change_points),
    "fact_closeout": over_tables(ev.fact_closeout),
    "project_scales": over_tables(ev.project_scales),
    "scaled_variance": over_tables(ev.scaled_variance),
    "project_week": over_tables(ev.project_week),
    "project_week_dense": over_tables(ev.project_week_dense),
    "project_closeout_summary": over_tables(leaks.project_closeout_summary),
    "top_leaks": over_tables(leaks.top_leaks),
    "leak_lines": over_tables(leaks.leak_lines),
    "leak_archetypes": over_tables(leaks.leak_archetypes),
    "cross_project_pattern": over_tables(leaks.cross_project_pattern),
    "co_leaking_work": over_tables(leaks.co_leaking_work),
    # streams
    "stream_labor_week": stream_labor_week,
    "stream_overrun_alerts": stream_overrun_alerts,
    "stream_overrun_events": stream_overrun_events,
    "labor_billing_wait": over_tables(labor_billing_wait),
    "stream_labor_billing_wait": stream_labor_billing_wait,
    # data quality
    "dq_primary_key": over_tables(quality.dq_primary_key),
    "dq_foreign_key": over_tables(quality.dq_foreign_key),
    "dq_domain": over_tables(quality.dq_domain),
    "dq_not_null": over_tables(quality.dq_not_null),
    "dq_length": over_tables(quality.dq_length),
    "dq_sov_sum": over_tables(quality.dq_sov_sum),
    "dq_billing_cap": over_tables(quality.dq_billing_cap),
    "dq_billing_cumulative": over_tables(quality.dq_billing_cumulative),
    "dq_cost_code": over_tables(quality.dq_cost_code),
}
