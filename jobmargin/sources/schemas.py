"""Typed schemas, keys, references and value domains of the portfolio tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    required: bool = True
    length: int | None = None


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]
    columns: tuple[Column, ...]
    free_text: bool = False

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, not c.required) for c in self.columns])

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


@dataclass(frozen=True)
class Reference:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def text(name: str, length: int | None = None, required: bool = True) -> Column:
    return Column(name, T.StringType(), required, length)


def money(name: str, precision: int = 12, scale: int = 2) -> Column:
    return Column(name, T.DecimalType(precision, scale))


def whole(name: str, required: bool = True) -> Column:
    return Column(name, T.IntegerType(), required)


def day(name: str, required: bool = True) -> Column:
    return Column(name, T.DateType(), required)


def flag(name: str) -> Column:
    return Column(name, T.BooleanType())


# Column names, types, lengths and nullability of the twelve tables.
TABLES = {
    t.name: t
    for t in (
        Table("contracts", ("project_id",), (
            text("project_id", 12), text("project_name", 100), money("original_contract_value", 15),
            day("contract_date"), day("substantial_completion_date"), money("retention_pct", 4, 3),
            text("payment_terms", 20), text("gc_name", 50), text("architect", 50),
            text("engineer_of_record", 50),
        )),
        Table("sov", ("sov_line_id",), (
            text("sov_line_id", 25), text("project_id", 12), whole("line_number"),
            text("description", 100), money("scheduled_value", 15), money("labor_pct", 5, 4),
            money("material_pct", 5, 4),
        )),
        Table("sov_budget", ("sov_line_id",), (
            text("sov_line_id", 25), text("project_id", 12), whole("estimated_labor_hours"),
            money("estimated_labor_cost"), money("estimated_material_cost"),
            money("estimated_equipment_cost"), money("estimated_sub_cost"),
            money("productivity_factor", 4, 2), text("key_assumptions", required=False),
        ), free_text=True),
        Table("rfis", ("project_id", "rfi_number"), (
            text("project_id", 12), text("rfi_number", 10), day("date_submitted"), text("subject"),
            text("submitted_by", 50), text("assigned_to", 50), text("priority", 10),
            text("status", 20), day("date_required"), day("date_responded", required=False),
            text("response_summary", required=False), flag("cost_impact"), flag("schedule_impact"),
        ), free_text=True),
        Table("change_orders", ("project_id", "co_number"), (
            text("project_id", 12), text("co_number", 10), day("date_submitted"),
            text("reason_category", 30), text("description"), money("amount"), text("status", 15),
            text("related_rfi", 10, required=False), whole("labor_hours_impact", required=False),
            whole("schedule_impact_days", required=False), text("submitted_by", 30),
            text("approved_by", 30, required=False),
        ), free_text=True),
        Table("change_order_sov_lines", ("project_id", "co_number", "sov_line_id"), (
            text("project_id", 12), text("co_number", 10), text("sov_line_id", 25),
        )),
        Table("labor_logs", ("log_id",), (
            text("log_id", 10), text("project_id", 12), day("date"), text("employee_id", 10),
            text("role", 30), text("sov_line_id", 25), money("hours_st", 4, 1),
            money("hours_ot", 4, 1), money("hourly_rate", 6, 2), money("burden_multiplier", 4, 2),
            text("work_area", 30, required=False), whole("cost_code"),
        )),
        Table("material_deliveries", ("delivery_id",), (
            text("delivery_id", 20), text("project_id", 12), day("date"), text("sov_line_id", 25),
            text("material_category", 20), text("item_description", 100), whole("quantity"),
            text("unit", 10), money("unit_cost"), money("total_cost"), text("po_number", 15),
            text("vendor", 50), text("received_by", 30), text("condition_notes", required=False),
        ), free_text=True),
        Table("field_notes", ("note_id",), (
            text("note_id", 10), text("project_id", 12), day("date"), text("author", 30),
            text("note_type", 20), text("content"), whole("photos_attached"),
            text("weather", 20, required=False), whole("temp_high", required=False),
            whole("temp_low", required=False),
        ), free_text=True),
        Table("billing_history", ("project_id", "application_number"), (
            text("project_id", 12), whole("application_number"), day("period_end"),
            money("period_total"), money("cumulative_billed"), money("retention_held"),
            money("net_payment_due"), text("status", 15), day("payment_date", required=False),
            whole("line_item_count"),
        )),
        Table("billing_line_items", ("sov_line_id", "project_id", "application_number"), (
            text("sov_line_id", 25), text("project_id", 12), whole("application_number"),
            text("description", 100), money("scheduled_value"), money("previous_billed"),
            money("this_period"), money("total_billed"), money("pct_complete", 5, 2),
            money("balance_to_finish"),
        )),
        Table("scope_creep_candidates", ("scope_id",), (
            text("scope_id", 10), text("project_id", 12), day("date"), text("author", 30),
            text("note_type", 20), whole("estimated_labor_hours"), money("estimated_material_cost"),
            text("approval_status", 15), text("co_status", 20), text("root_cause", 20),
            text("responsibility", 15), text("description"), text("full_description"),
        ), free_text=True),
    )
}

# The junction is derived from change_orders; it has no file of its own.
FILE_TABLES = tuple(name for name in TABLES if name != "change_order_sov_lines")

# References between the tables.
REFERENCES = (
    Reference("sov", ("project_id",), "contracts", ("project_id",)),
    Reference("sov_budget", ("project_id",), "contracts", ("project_id",)),
    Reference("labor_logs", ("project_id",), "contracts", ("project_id",)),
    Reference("material_deliveries", ("project_id",), "contracts", ("project_id",)),
    Reference("change_orders", ("project_id",), "contracts", ("project_id",)),
    Reference("rfis", ("project_id",), "contracts", ("project_id",)),
    Reference("field_notes", ("project_id",), "contracts", ("project_id",)),
    Reference("scope_creep_candidates", ("project_id",), "contracts", ("project_id",)),
    Reference("billing_history", ("project_id",), "contracts", ("project_id",)),
    Reference("sov_budget", ("sov_line_id",), "sov", ("sov_line_id",)),
    Reference("labor_logs", ("sov_line_id",), "sov", ("sov_line_id",)),
    Reference("material_deliveries", ("sov_line_id",), "sov", ("sov_line_id",)),
    Reference("billing_line_items", ("sov_line_id",), "sov", ("sov_line_id",)),
    Reference("change_orders", ("project_id", "related_rfi"), "rfis", ("project_id", "rfi_number")),
    Reference("billing_line_items", ("project_id", "application_number"),
              "billing_history", ("project_id", "application_number")),
    Reference("change_order_sov_lines", ("project_id", "co_number"),
              "change_orders", ("project_id", "co_number")),
    Reference("change_order_sov_lines", ("sov_line_id",), "sov", ("sov_line_id",)),
)

# Allowed values per checked column.
DOMAINS = {
    ("rfis", "priority"): ("Low", "Medium", "High", "Critical"),
    ("rfis", "status"): ("Open", "Pending Response", "Closed"),
    ("change_orders", "status"): ("Pending", "Under Review", "Approved", "Rejected"),
    ("billing_history", "status"): ("Pending", "Approved", "Paid"),
    ("scope_creep_candidates", "approval_status"): ("verbal", "written", "none", "undocumented"),
    ("scope_creep_candidates", "co_status"):
        ("not_submitted", "pending", "absorbed", "awaiting_approval"),
    ("scope_creep_candidates", "responsibility"):
        ("owner", "gc", "architect", "vendor", "tbd", "self_absorbed", "code_compliance"),
}
