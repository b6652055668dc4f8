"""The portfolio tables as lazy views over the benchmark's star schema.

A supplier is a project and a (supplier, line number) pair is an SOV line; orders
become change orders and RFIs, events scope items, documents field notes.  Sums keep
Spark's widened decimal types, so one very large project does not overflow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmargin.functions.text import shortened
from jobmargin.session import parts_by_input
from jobmargin.sources.junction import co_sov_lines

# Texts the views assign by position.
LINE_DESCRIPTIONS = (
    "General Conditions", "Submittals", "Ductwork", "Equipment - Terminal Units", "Piping",
    "Controls - Commissioning", "TAB",
)
REASONS = {
    "1-URGENT": "Acceleration", "2-HIGH": "Design Error", "3-MEDIUM": "Unforeseen Condition",
    "5-LOW": "Value Engineering",
}
PRIORITIES = {
    "1-URGENT": "Critical", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Unspecified",
    "5-LOW": "Low",
}
EVENT_CO_STATUS = {
    "click": "not_submitted", "signup": "not_submitted", "view": "pending", "purchase": "absorbed",
    "error": "awaiting_approval",
}
RESPONSIBILITIES = ("owner", "gc", "architect", "vendor", "tbd", "self_absorbed", "code_compliance")
APPROVALS = ("verbal", "written", "none", "undocumented")
NOTE_TYPES = ("Daily Report", "Safety Log", "Coordination Note", "Issue Log")
BILLING_STATUSES = ("Pending", "Approved", "Paid")

SHARE = 1 << 20        # bytes of line items and orders for each partition of the billing windows


def _pick(values: tuple[str, ...], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def _map(values: dict[str, str], column: str) -> Column:
    expr = None
    for key, value in values.items():
        expr = F.when(F.col(column) == key, value) if expr is None else expr.when(F.col(column) == key, value)
    return expr


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(12,2)")


def _cents(column: str) -> Column:
    """Whole cents of a price held as double; exact, and much cheaper to sum than decimals."""
    return F.round(F.col(column) * 100).cast("bigint")


def _dollars(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(22,2)")


def _hundredths(number: Column) -> Column:
    """An integer count of hundredths as decimal(4,2)."""
    return (number.cast("decimal(4,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(4,2)")


def project_key(number: Column) -> Column:
    """PRJ- and the number, zero-filled to six digits and never cut; NULL stays NULL."""
    digits = number.cast("string")
    filled = F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))
    return F.concat(F.lit("PRJ-"), filled)


def line_key(project_number: Column, line_number: Column) -> Column:
    return F.concat(project_key(project_number), F.lit("-SOV-0"), line_number.cast("string"))


class BridgeTables(Mapping):
    """The twelve tables, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}
        self._sources: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = BUILDERS[name](self)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(BUILDERS)

    def __len__(self) -> int:
        return len(BUILDERS)

    def source(self, name: str) -> DataFrame:
        if name not in self._sources:
            self._sources[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._sources[name]

    def project_of(self, number: str) -> Column:
        """Spread a number over the projects; their count is a subquery of the plan."""
        projects = self.source("supplier").agg(F.count(F.lit(1))).scalar()
        return project_key(F.col(number) % projects)


def bridge(spark: SparkSession, folder: str) -> BridgeTables:
    return BridgeTables(spark, folder)


def _line_totals(t: BridgeTables) -> DataFrame:
    worked, returned = F.col("l_returnflag").isin("A", "N"), F.col("l_returnflag") == "R"
    price = _cents("l_extendedprice")
    return (
        t.source("lineitem")
        .groupBy("l_suppkey", "l_linenumber")
        .agg(
            F.sum(price).alias("value"),
            F.sum(F.when(worked, F.col("l_quantity").cast("bigint")).otherwise(F.lit(0))).alias("hours"),
            F.sum(F.when(returned, price).otherwise(F.lit(0))).alias("material"),
        )
        .withColumns({"value": _dollars(F.col("value")), "material": _dollars(F.col("material"))})
    )


def _contracts(t: BridgeTables) -> DataFrame:
    totals = t.source("lineitem").groupBy("l_suppkey").agg(
        _dollars(F.sum(_cents("l_extendedprice"))).alias("value"),
        F.max(F.col("l_shipdate").cast("date")).alias("completion"),
    )
    # The nation table has a fixed 25 rows, whatever the scale.
    nations = F.broadcast(t.source("nation").select("n_nationkey", "n_name"))
    return (
        t.source("supplier")
        .join(totals, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            project_key(F.col("s_suppkey")).alias("project_id"),
            F.col("s_name").alias("project_name"),
            F.coalesce(F.col("value"), F.lit(0)).alias("original_contract_value"),
            F.to_date(F.lit("1992-01-01")).alias("contract_date"),
            F.coalesce("completion", F.to_date(F.lit("1992-01-01"))).alias("substantial_completion_date"),
            F.lit("0.100").cast("decimal(4,3)").alias("retention_pct"),
            F.lit("Net 30").alias("payment_terms"),
            F.col("n_name").alias("gc_name"),
            F.concat(F.lit("Architect "), (F.col("s_suppkey") % 7).cast("string")).alias("architect"),
            F.concat(F.lit("Engineer "), (F.col("s_suppkey") % 5).cast("string")).alias("engineer_of_record"),
        )
    )


def _sov(t: BridgeTables) -> DataFrame:
    line = F.col("l_linenumber")
    return _line_totals(t).select(
        line_key(F.col("l_suppkey"), line).alias("sov_line_id"),
        project_key(F.col("l_suppkey")).alias("project_id"),
        line.alias("line_number"),
        _pick(LINE_DESCRIPTIONS, line - 1).alias("description"),
        F.col("value").alias("scheduled_value"),
        ((F.lit(50) + line) / 100).cast("decimal(5,4)").alias("labor_pct"),
        ((F.lit(40) - line) / 100).cast("decimal(5,4)").alias("material_pct"),
    )


def _sov_budget(t: BridgeTables) -> DataFrame:
    supplier, line = F.col("l_suppkey"), F.col("l_linenumber")
    unbudgeted = (line == 7) & (supplier % 5 == 0)
    labor = F.col("hours") * (50 + 5 * ((supplier + line) % 7))
    return _line_totals(t).select(
        line_key(supplier, line).alias("sov_line_id"),
        project_key(supplier).alias("project_id"),
        F.col("hours").alias("estimated_labor_hours"),
        F.when(unbudgeted, F.lit(0)).otherwise(labor).cast("decimal(22,2)").alias("estimated_labor_cost"),
        (F.col("material") * F.lit("0.9").cast("decimal(2,1)")).cast("decimal(24,2)")
        .alias("estimated_material_cost"),
        F.lit(0).cast("decimal(12,2)").alias("estimated_equipment_cost"),
        F.when(line == 7, F.lit(5000)).otherwise(F.lit(0)).cast("decimal(12,2)").alias("estimated_sub_cost"),
        ((F.lit(80) + 5 * (line % 5)).cast("decimal(9,2)") / 100).cast("decimal(4,2)")
        .alias("productivity_factor"),
        F.concat(F.lit("Standard productivity for line "), line.cast("string")).alias("key_assumptions"),
    )


def _entry_number() -> Column:
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.unix_date(F.col("l_shipdate").cast("date")),
    )


def labor_from_lineitem(items: DataFrame) -> DataFrame:
    """Labor entries from line items, batch or stream."""
    supplier, line = F.col("l_suppkey"), F.col("l_linenumber")
    cap = F.when((supplier + line) % 9 == 0, F.lit(30)).otherwise(F.lit(40))
    quantity = F.col("l_quantity").cast("int")
    return items.where(F.col("l_returnflag").isin("A", "N")).select(
        F.concat(F.when(quantity >= 48, "OVR-").otherwise("LOG-"), _entry_number()).alias("log_id"),
        project_key(supplier).alias("project_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat(F.lit("EMP-"), (F.col("l_partkey") % 997).cast("string")).alias("employee_id"),
        F.when(line % 2 == 0, "Pipefitter").otherwise("Sheet Metal Worker").alias("role"),
        line_key(supplier, line).alias("sov_line_id"),
        F.least(quantity, cap).cast("decimal(4,1)").alias("hours_st"),
        F.greatest(quantity - cap, F.lit(0)).cast("decimal(4,1)").alias("hours_ot"),
        (F.lit(25) + 5 * line).cast("decimal(6,2)").alias("hourly_rate"),
        _hundredths(F.round(F.col("l_tax") * 100).cast("int") + 135).alias("burden_multiplier"),
        F.concat(F.lit("Zone "), F.col("l_linestatus")).alias("work_area"),
        line.alias("cost_code"),
    )


def _labor_logs(t: BridgeTables) -> DataFrame:
    return labor_from_lineitem(t.source("lineitem"))


def _material_deliveries(t: BridgeTables) -> DataFrame:
    supplier, line = F.col("l_suppkey"), F.col("l_linenumber")
    kept = _hundredths(100 - F.round(F.col("l_discount") * 100).cast("int"))
    cost = (_money("l_extendedprice") * kept).cast("decimal(12,2)")
    return t.source("lineitem").where(F.col("l_returnflag") == "R").select(
        F.concat(F.lit("DEL-"), _entry_number()).alias("delivery_id"),
        project_key(supplier).alias("project_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        line_key(supplier, line).alias("sov_line_id"),
        _pick(LINE_DESCRIPTIONS, line - 1).alias("material_category"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("item_description"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.lit("EA").alias("unit"),
        (cost / F.col("l_quantity").cast("decimal(9,0)")).cast("decimal(12,2)").alias("unit_cost"),
        cost.alias("total_cost"),
        F.concat(F.lit("PO-"), F.col("l_orderkey").cast("string")).alias("po_number"),
        F.concat(F.lit("Vendor "), (F.col("l_partkey") % 50).cast("string")).alias("vendor"),
        F.concat(F.lit("Foreman "), line.cast("string")).alias("received_by"),
        F.when(F.col("l_linestatus") == "O", "Open").alias("condition_notes"),
    )


def _monthly_billing(t: BridgeTables) -> DataFrame:
    """Amounts billed per supplier, line and month, with the application number of the month."""
    items = t.source("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    orders = t.source("orders").select(
        "o_orderkey", F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"))
    supplier = F.col("l_suppkey")
    factor = (
        F.when(supplier % 5 == 0, F.lit("0.25")).when(supplier % 5 == 1, F.lit("0.28"))
        .otherwise(F.lit("1.00")).cast("decimal(3,2)")
    )
    value = _dollars(F.col("cents"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # Months of all lines widen manyfold in the windows, so their partitions follow the input and not what is shuffled.
    parts = parts_by_input(joined, SHARE)
    return (
        joined.groupBy("l_suppkey", "l_linenumber", "month")
        .agg(F.sum(_cents("l_extendedprice")).alias("cents"))
        # A month counts where something was billed.  As every use of the table keeps the
        # sum for this test, their exchanges are equal and Spark runs the join once.
        .where(F.col("cents").isNotNull())
        .repartition(*[parts] * (parts > 0), "l_suppkey")
        .select(
            "l_suppkey", "l_linenumber", "month", value.alias("value"),
            (value * factor).cast("decimal(24,2)").alias("this_period"),
            F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("month")).alias("application_number"),
        )
    )


def _billing_line_items(t: BridgeTables) -> DataFrame:
    supplier, line = F.col("l_suppkey"), F.col("l_linenumber")
    by_line = Window.partitionBy("l_suppkey", "l_linenumber")
    running = by_line.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total, scheduled = F.col("total_billed"), F.col("scheduled_value")
    return (
        _monthly_billing(t)
        .withColumns({
            "total_billed": F.sum("this_period").over(running),
            "scheduled_value": F.sum("value").over(by_line),
        })
        .select(
            line_key(supplier, line).alias("sov_line_id"),
            project_key(supplier).alias("project_id"),
            "application_number",
            _pick(LINE_DESCRIPTIONS, line - 1).alias("description"),
            scheduled,
            (total - F.col("this_period")).alias("previous_billed"),
            "this_period",
            total,
            (total.cast("double") * 100 / scheduled.cast("double")).cast("decimal(5,2)").alias("pct_complete"),
            (scheduled - total).alias("balance_to_finish"),
        )
    )


def _billing_history(t: BridgeTables) -> DataFrame:
    # Grouped and summed by supplier number, which the application numbers are partitioned by.
    per_application = _monthly_billing(t).groupBy("l_suppkey", "application_number", "month").agg(
        F.sum("this_period").alias("period_total"), F.count(F.lit(1)).alias("line_item_count")
    )
    running = (
        Window.partitionBy("l_suppkey").orderBy("application_number")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    period_end, billed = F.last_day("month"), F.col("cumulative_billed")
    retention = (billed * F.lit("0.10").cast("decimal(2,2)")).cast("decimal(30,2)")
    return (
        per_application.withColumn("cumulative_billed", F.sum("period_total").over(running))
        .select(
            project_key(F.col("l_suppkey")).alias("project_id"),
            "application_number", period_end.alias("period_end"), "period_total", "cumulative_billed",
            retention.alias("retention_held"),
            (billed - retention).alias("net_payment_due"),
            _pick(BILLING_STATUSES, F.col("application_number") % 3).alias("status"),
            F.date_add(period_end, 40).alias("payment_date"),
            "line_item_count",
        )
    )


def _change_orders(t: BridgeTables) -> DataFrame:
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    project = t.project_of("o_custkey")
    amount = (_money("o_totalprice") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(12,2)")
    lines = F.concat(
        F.lit("['"), F.col("project_id"), F.lit("-SOV-0"), (key % 7 + 1).cast("string"),
        F.lit("', '"), F.col("project_id"), F.lit("-SOV-0"), ((key + 3) % 7 + 1).cast("string"), F.lit("']"),
    )
    approved = F.col("o_orderstatus") == "F"
    return t.source("orders").withColumn("project_id", project).select(
        "project_id",
        F.concat(F.lit("CO-"), key.cast("string")).alias("co_number"),
        F.col("o_orderdate").cast("date").alias("date_submitted"),
        _map(REASONS, "o_orderpriority").alias("reason_category"),
        F.concat(F.lit("Change for order "), key.cast("string")).alias("description"),
        F.when(priority == "5-LOW", -amount).otherwise(amount).alias("amount"),
        F.when(approved, "Approved").when(F.col("o_orderstatus") == "O", "Rejected")
        .when(key % 2 == 0, "Pending").otherwise("Under Review").alias("status"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), F.concat(F.lit("RFI-"), key.cast("string")))
        .alias("related_rfi"),
        F.when(key % 97 == 0, "[bad").when(key % 11 == 0, None).when(key % 13 == 0, "[]")
        .otherwise(lines).alias("affected_sov_lines"),
        (key % 200).cast("int").alias("labor_hours_impact"),
        (key % 15).cast("int").alias("schedule_impact_days"),
        F.concat(F.lit("PM "), (F.col("o_custkey") % 9).cast("string")).alias("submitted_by"),
        F.when(approved, "Owner Rep").alias("approved_by"),
    )


def _rfis(t: BridgeTables) -> DataFrame:
    key = F.col("o_orderkey")
    first_shipped = t.source("lineitem").groupBy("l_orderkey").agg(
        F.min(F.col("l_shipdate").cast("date")).alias("shipped"))
    customers = t.source("customer").select("c_custkey", "c_mktsegment")
    responded = F.when(F.col("o_orderstatus") != "P", F.col("shipped"))
    submitted = F.col("o_orderdate").cast("date")
    return (
        t.source("orders")
        .join(first_shipped, key == F.col("l_orderkey"), "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .withColumn("project_id", t.project_of("o_custkey"))
        .select(
            "project_id",
            F.concat(F.lit("RFI-"), key.cast("string")).alias("rfi_number"),
            submitted.alias("date_submitted"),
            F.concat(F.lit("Question on order "), key.cast("string")).alias("subject"),
            F.concat(F.lit("PM "), (F.col("o_custkey") % 9).cast("string")).alias("submitted_by"),
            F.col("c_mktsegment").alias("assigned_to"),
            _map(PRIORITIES, "o_orderpriority").alias("priority"),
            F.when(responded.isNotNull(), "Closed").when(key % 2 == 0, "Open")
            .otherwise("Pending Response").alias("status"),
            F.date_add(submitted, 14).alias("date_required"),
            responded.alias("date_responded"),
            F.when(responded.isNotNull(), "Answered").alias("response_summary"),
            (key % 2 == 0).alias("cost_impact"),
            (key % 4 == 0).alias("schedule_impact"),
        )
    )


def _scope_creep_candidates(t: BridgeTables) -> DataFrame:
    event = F.col("event_id")
    story = F.concat(
        F.lit("Event "), event.cast("string"), F.lit(" of type "), F.col("event_type"), F.lit(": "),
        F.repeat(F.col("props"), (event % 30 + 1).cast("int")),
    )
    return t.source("events").withColumn("full_description", story).select(
        F.concat(F.lit("SCOPE-"), event.cast("string")).alias("scope_id"),
        t.project_of("user_id").alias("project_id"),
        F.col("ts").cast("date").alias("date"),
        F.concat(F.lit("Foreman "), (F.col("user_id") % 20).cast("string")).alias("author"),
        _pick(NOTE_TYPES, event % 4).alias("note_type"),
        F.floor("value").cast("int").alias("estimated_labor_hours"),
        ((event % 50) * 10).cast("decimal(12,2)").alias("estimated_material_cost"),
        _pick(APPROVALS, event % 4).alias("approval_status"),
        _map(EVENT_CO_STATUS, "event_type").alias("co_status"),
        F.when(event % 3 == 0, "design_conflict").otherwise("owner_change").alias("root_cause"),
        _pick(RESPONSIBILITIES, event % 7).alias("responsibility"),
        shortened("full_description", 200).alias("description"),
        "full_description",
    )


def _field_notes(t: BridgeTables) -> DataFrame:
    doc = F.col("doc_id")
    return t.source("documents").select(
        F.concat(F.lit("NOTE-"), doc.cast("string")).alias("note_id"),
        t.project_of("doc_id").alias("project_id"),
        F.date_add(F.to_date(F.lit("1998-01-01")), (doc % 730).cast("int")).alias("date"),
        F.col("source").alias("author"),
        _pick(NOTE_TYPES, doc % 4).alias("note_type"),
        F.col("text").alias("content"),
        (doc % 6).cast("int").alias("photos_attached"),
        F.when(doc % 3 == 0, "Rain").when(doc % 3 == 1, "Clear").alias("weather"),
        (F.lit(60) + doc % 30).cast("int").alias("temp_high"),
        (F.lit(40) + doc % 15).cast("int").alias("temp_low"),
    )


BUILDERS: dict[str, Callable[[BridgeTables], DataFrame]] = {
    "contracts": _contracts,
    "sov": _sov,
    "sov_budget": _sov_budget,
    "rfis": _rfis,
    "change_orders": _change_orders,
    "change_order_sov_lines": co_sov_lines,
    "labor_logs": _labor_logs,
    "material_deliveries": _material_deliveries,
    "field_notes": _field_notes,
    "billing_history": _billing_history,
    "billing_line_items": _billing_line_items,
    "scope_creep_candidates": _scope_creep_candidates,
}
