"""Quality reports on seeded bad rows."""

from jobmargin.operators import quality
from jobmargin.sources.schemas import Reference
from tests.portfolio import ROWS, by, portfolio


def test_keys_and_references(spark):
    labor = [*ROWS["labor_logs"][1], "LOG-1,P9,2024-01-01,P1-1,1,0,1,1,1", "LOG-1,P9,2024-01-01,P9-9,1,0,1,1,1"]
    tables = portfolio(spark, labor_logs=labor)
    row = by(quality.dq_primary_key(tables), "table_name")["labor_logs"]
    assert (row["row_count"], row["duplicate_keys"], row["duplicate_rows"]) == (9, 1, 2)
    rows = by(quality.dq_foreign_key(tables), "child_table", "columns")
    assert rows["labor_logs", "project_id"]["orphan_rows"] == 2
    assert rows["labor_logs", "sov_line_id"]["orphan_keys"] == 1
    assert rows["change_orders", "project_id,related_rfi"]["orphan_keys"] == 1   # P2 has no R-1
    assert rows["sov", "project_id"]["orphan_keys"] == 0
    one = quality.dq_foreign_key(tables, [Reference("rfis", ("project_id",), "contracts", ("project_id",))])
    assert one.count() == 1


def test_domains_lengths_and_nulls(spark):
    tables = portfolio(spark)
    rows = quality.dq_domain(tables).collect()
    assert ("rfis", "priority", "Odd", 1) in [tuple(r) for r in rows]
    nulls = by(quality.dq_not_null(tables), "table_name", "column_name")
    assert nulls["change_orders", "reason_category"]["null_rows"] == 1
    assert nulls["contracts", "project_id"]["null_rows"] == 0
    lengths = by(quality.dq_length(tables), "table_name", "column_name")
    assert lengths["contracts", "project_name"]["longest"] == len("Alpha Hospital Tower")
    assert lengths["sov", "description"]["rows_over"] == 0


def test_business_rules(spark):
    tables = portfolio(spark, billing_history=[
        "P1,2,2024-01-14,200,200", "P1,4,2024-01-31,150,351", "P2,1,2024-01-31,100,100"],
        billing_line_items=["P1-1,P1,2,D,600,0,120,700,20", "P2-1,P2,1,D,300,0,100,100,5"])
    sums = by(quality.dq_sov_sum(tables), "project_id")
    assert sums["P1"]["ok"] and sums["P3"]["ok"]
    assert by(quality.dq_billing_cap(tables), "project_id")["P1"]["lines_over"] == 1
    cumulative = by(quality.dq_billing_cumulative(tables), "project_id")
    assert (cumulative["P1"]["mismatches"], cumulative["P2"]["mismatches"]) == (1, 0)
    codes = by(quality.dq_cost_code(tables), "project_id")["P1"]
    assert (codes["wrong_rows"], codes["unknown_line_rows"]) == (1, 0)
    fewer = {**tables, "sov": tables["sov"].where("sov_line_id <> 'P1-1'")}
    unknown = by(quality.dq_cost_code(fewer), "project_id")["P1"]
    assert unknown["labor_rows"] == codes["labor_rows"] and unknown["unknown_line_rows"] > 0
