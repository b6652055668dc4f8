"""A small portfolio with the awkward cases, as rows of text read by the library's own typed reader.

P1 is ordinary, P2 has a line without budget and one missing from the last application, P3 has
neither billing nor change orders.
"""

from __future__ import annotations

from jobmargin.sources.junction import co_sov_lines
from jobmargin.sources.readers import normalise
from jobmargin.sources.schemas import TABLES

ROWS = {
    "contracts": ("project_id,project_name,original_contract_value", [
        "P1,Alpha Hospital Tower,1000", "P2,Beta,500", "P3,Gamma,0"]),
    "sov": ("sov_line_id,project_id,line_number,description,scheduled_value", [
        "P1-1,P1,1,Ductwork,600", "P1-2,P1,2,Piping,400", "P2-1,P2,1,Ductwork,300",
        "P2-2,P2,2,Controls - Commissioning,200", "P3-1,P3,1,Ductwork,0"]),
    "sov_budget": ("sov_line_id,project_id,estimated_labor_hours,estimated_labor_cost,"
                   "estimated_material_cost,estimated_equipment_cost,estimated_sub_cost,productivity_factor", [
        "P1-1,P1,10,300,100,10,5,0.5", "P1-2,P1,10,200,100,0,0,1", "P2-1,P2,5,100,50,0,0,1",
        "P2-2,P2,0,0,0,0,40,0", "P3-1,P3,5,100,0,0,0,1"]),
    "labor_logs": ("log_id,project_id,date,sov_line_id,hours_st,hours_ot,hourly_rate,burden_multiplier,cost_code", [
        "LOG-1,P1,2024-01-01,P1-1,8,2,20,1.5,1",     # Monday, 330
        "LOG-2,P1,2024-01-07,P1-1,4,0,20,1.5,1",     # Sunday of the same week, 120
        "LOG-3,P1,2024-01-08,P1-2,5,0,20,1,2",       # Monday of the next week, 100
        "OVR-4,P1,2024-12-31,P1-2,5,0,20,1,9",       # after the last billing, wrong cost code, 100
        "LOG-5,P2,2024-01-02,P2-1,2,0,30,1,1",       # 60
        "LOG-6,P2,2024-01-09,P2-2,1,0,50,1,2",       # unbudgeted, 50
        "LOG-7,P3,2024-01-02,P3-1,1,0,10,1,1"]),     # project without billing, 10
    "material_deliveries": ("delivery_id,project_id,date,sov_line_id,quantity,total_cost", [
        "D1,P1,2024-01-03,P1-1,3,90", "D2,P2,2024-01-31,P2-1,1,40"]),
    "billing_history": ("project_id,application_number,period_end,period_total,cumulative_billed", [
        "P1,2,2024-01-14,200,200", "P1,4,2024-01-31,150,350", "P2,1,2024-01-31,100,100"]),
    "billing_line_items": ("sov_line_id,project_id,application_number,description,scheduled_value,"
                           "previous_billed,this_period,total_billed,pct_complete", [
        "P1-1,P1,2,Ductwork,600,0,120,120,20", "P1-2,P1,2,Piping,400,0,80,80,150",
        "P1-1,P1,4,,600,120,150,270,45",             # no description
        "P2-1,P2,1,Ductwork,300,0,100,100,-5"]),     # negative percent; P2-2 was never billed
    "change_orders": ("project_id,co_number,date_submitted,reason_category,amount,status,related_rfi,"
                      "affected_sov_lines", [
        "P1|CO-1|2024-01-02|Scope Gap|100|Approved|R-1|['P1-1', 'P1-2']",
        "P1|CO-2|2024-01-03||-30|Approved||['P1-1']",
        "P1|CO-3|2024-01-04|Scope Gap|60|Pending||[bad",
        "P2|CO-1|2024-01-05|Acceleration|70|Under Review|R-1|[]",
        "P2|CO-2|2024-01-05|Acceleration|20|Rejected||['it's']"]),
    "rfis": ("project_id,rfi_number,date_submitted,assigned_to,priority,status,date_required,date_responded,cost_impact", [
        "P1,R-1,2024-01-01,Ann,High,Closed,2024-01-10,2024-01-05,TRUE",
        "P1,R-2,2024-01-01,Ann,Odd,Open,2024-01-10,,1", "P2,R-3,2024-01-01,Bob,Low,Open,2024-01-10,,yes"]),
    "scope_creep_candidates": ("scope_id,project_id,estimated_labor_hours,estimated_material_cost,"
                               "co_status,responsibility,full_description", [
        "S1,P1,10,50,not_submitted,owner,short", "S2,P1,1,0,absorbed,self_absorbed,short",
        "S3,P1,2,0,not_submitted,self_absorbed," + "x" * 201, "S4,P2,3,5,pending,tbd," + "y" * 200]),
    "field_notes": ("note_id,project_id,date,note_type,content", [
        "N1,P1,2024-01-02,Daily Report,Rain delay in zone_A", "N2,P1,2024-01-03,Issue Log,100% done; no delays",
        "N3,P2,2024-01-03,Daily Report,zoneXA rework RAIN"]),
}


def frame(spark, name, header, lines):
    columns = header.split(",")
    separator = "|" if name == "change_orders" else ","
    rows = [tuple(line.split(separator)) for line in lines]
    schema = ", ".join(f"{c} string" for c in columns)
    extra = ("affected_sov_lines",) if name == "change_orders" else ()
    return normalise(spark.createDataFrame(rows, schema), TABLES[name], extra, strict=False)


def portfolio(spark, **replaced):
    """The tables; a keyword replaces the rows of one table."""
    tables = {
        name: frame(spark, name, header, replaced.get(name, lines)) for name, (header, lines) in ROWS.items()
    }
    tables["change_order_sov_lines"] = co_sov_lines(tables)
    return tables


def by(df, *keys):
    """Rows as dicts by key."""
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        out[key if len(keys) > 1 else key[0]] = row.asDict()
    return out
