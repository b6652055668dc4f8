"""Values and traps of the analyses on the small portfolio."""

import pytest

from jobmargin.functions import measures as m
from jobmargin.operators import alerts, billing, changes, labor, margin, notes, portfolio as po, scope
from jobmargin.operators.adhoc import select_sql
from jobmargin.plans import latest, ledger
from tests.portfolio import by, portfolio


@pytest.fixture(scope="module")
def tables(spark):
    return portfolio(spark)


def test_published_margins(spark):
    """Margins of a published project, from its totals."""
    from pyspark.sql import functions as F
    from decimal import Decimal as D
    df = spark.createDataFrame(
        [(D("35194000"), D("3472590"), D("34955400"), D("17494950.27"))],
        "v decimal(15,2), b decimal(15,2), billed decimal(15,2), c decimal(15,2)")
    row = df.select(
        m.bid_margin(F.col("v"), F.col("b")), m.realized_margin(F.col("billed"), F.col("c"))).first()
    assert row[0] == pytest.approx(0.901330, abs=1e-6)
    assert row[1] == pytest.approx(0.499507, abs=1e-6)


def test_overview(tables):
    row = po.portfolio_overview(tables).first()
    assert row.project_count == 3 and row.total_contract_value == 1500
    assert row.total_bid_cost == 1005
    assert row.total_billed == 450
    assert row.actual_labor_cost == 330 + 120 + 100 + 100 + 60 + 50 + 10
    assert row.at_risk_amount == (10 * 85 + 50) + 2 * 85
    assert (row.pending_cos, row.pending_co_amount) == (2, 130)


def test_overview_of_nothing(spark):
    """Totals of an empty portfolio are zeros, not NULL."""
    empty = {k: v.limit(0) for k, v in portfolio(spark).items()}
    row = po.portfolio_overview(empty).first()
    assert row.project_count == 0 and row.total_billed == 0 and row.bid_margin == 0


def test_project_without_facts_keeps_zeros(tables):
    row = by(po.project_summaries(tables), "project_id")["P3"]
    assert row["total_billed"] == 0 and row["realized_margin_pct"] == 0 and row["bid_margin_pct"] == 0
    assert row["approved_cos"] == 0 and row["pct_complete"] == 0


def test_guards_differ_for_negative_denominators(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(
        m.share(F.lit(1), F.lit(-2)).alias("a"), m.share_if_positive(F.lit(1), F.lit(-2)).alias("b"),
        m.share(F.lit(1), F.lit(0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (-0.5, 0.0, 0.0)


def test_latest_lines_are_those_of_the_projects_last_application(tables):
    rows = by(ledger.latest_billing_lines(tables), "sov_line_id")
    assert set(rows) == {"P1-1", "P2-1"}
    lines = by(billing.billing_lag_by_sov_line(tables), "sov_line_id")
    assert lines["P1-2"]["billed"] == 0 and lines["P1-2"]["lag"] == 200
    assert by(latest.latest_billing(tables), "project_id")["P1"]["application_number"] == 4
    assert latest.latest_billing_one(tables, "P1").first().application_number == 4


def test_margin_by_line_and_project_filter(tables):
    rows = by(margin.margin_by_sov_line(tables, "P1"), "sov_line_id")
    assert set(rows) == {"P1-1", "P1-2"}
    assert rows["P1-1"]["variance"] == 415 - (330 + 120 + 90)
    everything = by(margin.margin_by_sov_line(tables), "sov_line_id")
    assert everything["P1-1"] == rows["P1-1"]


def test_margin_rank_counts_ties(spark):
    tables = portfolio(spark)
    rows = by(margin.margin_rank(tables), "project_id")
    expected = sorted(r["margin_delta"] for r in rows.values())
    for row in rows.values():
        assert row["margin_rank"] == 1 + sum(d < row["margin_delta"] for d in expected)


def test_unbudgeted_line_is_flagged_with_zero_share(tables):
    rows = by(labor.labor_overruns(tables), "sov_line_id")
    assert rows["P2-2"]["flagged"] and rows["P2-2"]["cost_overrun_pct"] == 0
    assert rows["P1-1"]["flagged"] and rows["P1-1"]["cost_overrun_pct"] == pytest.approx(0.5)
    assert not rows["P3-1"]["flagged"]
    total = labor.labor_overrun_total(tables).first()
    assert (total.flagged_count, total.total_overrun_amount) == (2, 200)


def test_scope_classes_overlap(tables):
    row = scope.scope_summary(tables).first()
    assert (row.total_items, row.recoverable_count, row.absorbed_count, row.pending_count) == (4, 1, 2, 1)
    assert row.recoverable_total == 900 and row.absorbed_total == 3 * 85
    texts = by(scope.scope_description(tables), "scope_id")
    assert texts["S3"]["description"] == "x" * 200 + "..." and texts["S4"]["description"] == "y" * 200


def test_rework(tables):
    row = scope.rework_labor(tables).first()
    assert (row.project_id, row.entries, row.hours, row.cost) == ("P1", 1, 5, 100)
    ratios = by(scope.rework_vs_scope(tables), "project_id")
    assert ratios["P1"]["rework_ratio"] == pytest.approx(5 / 13)


def test_change_orders(tables):
    assert by(changes.co_reason_summary(tables), "reason")["Unknown"]["total_amount"] == -30
    row = by(changes.co_additions_credits(tables), "project_id")["P1"]
    assert (row["additions"], row["credits"]) == (100, -30)
    zero = by(changes.co_summary_by_project(tables), "project_id")["P3"]
    assert zero["total_cos"] == 0 and zero["approved_amount"] == 0
    linked = by(changes.co_with_rfi(tables), "project_id", "co_number")
    assert linked["P1", "CO-1"]["rfi_status"] == "Closed"
    assert linked["P2", "CO-1"]["rfi_status"] is None  # same number, other project


def test_rfis(tables):
    assert by(changes.rfi_response_days(tables), "assigned_to") == {"Ann": {"assigned_to": "Ann", "avg_days": 4.0}}
    rows = changes.rfi_cost_exposure(tables).collect()
    assert [(r.project_id, r.priority, r.open_rfis) for r in rows] == [("P1", "Odd", 1)]


def test_alerts_equal_their_parts_and_are_ordered(tables):
    thresholds = alerts.Thresholds(scope_high="800", pending="50")
    parts = [f(tables, thresholds).collect() for f in (
        alerts.alert_scope_creep, alerts.alert_labor_overrun, alerts.alert_billing_lag, alerts.alert_pending_co)]
    together = alerts.risk_alerts(tables, thresholds).collect()
    assert sorted(map(tuple, together)) == sorted(tuple(r) for part in parts for r in part)
    order = [({"high": 0, "medium": 1}[r.severity], -r.amount) for r in together]
    assert order == sorted(order)
    messages = {(r.type, r.project_id): r.message for r in together}
    assert messages["scope_creep", "P1"] == "1 unsubmitted scope creep item(s) totaling $900.00"
    assert messages["labor_overrun", "P1"] == "Labor cost $650.00 exceeds budget $500.00 by 30.0%"
    assert messages["billing_lag", "P1"] == \
        "Costs exceed billing by 111.4% — actual $740.00 vs billed $350.00"


def test_notes(tables):
    def found(**filters):
        return {r.note_id for r in notes.field_notes_search(tables, **filters).collect()}

    assert found(search="rain") == {"N1", "N3"}
    assert found(search="zone_A") == {"N1", "N3"}      # _ is a wildcard
    assert found(search="100%done") == {"N2"}          # so is %
    assert found(search="no_delays") == {"N2"} and found(search="done;no") == set()
    assert found(search="", project_id="P1") == {"N1", "N2"}
    assert found(search="rain", note_type="Daily Report", project_id="P2") == {"N3"}
    assert found() == {"N1", "N2", "N3"}
    assert {r.note_id for r in notes.field_notes_token_search(tables, ["Delay"]).collect()} == {"N1"}
    assert {r.note_id for r in labor.overrun_notes(tables).collect()} == {"N1", "N2", "N3"}
    assert [r.note_id for r in notes.field_notes_recent(tables, 2).collect()] == ["N2", "N3"]


def test_select_sql(spark, tables):
    rows = select_sql(spark, tables, " select count(*) AS n from contracts; ").collect()
    assert rows[0].n == 3
    for bad in ("WITH x AS (SELECT 1) SELECT * FROM x", "DROP TABLE contracts", "SELECTED", ""):
        with pytest.raises(ValueError):
            select_sql(spark, tables, bad)


def test_bands_and_names(tables):
    rows = by(po.margin_chart_data(tables), "project_id")
    assert rows["P1"]["name"] == "Alpha Hospital ..." and rows["P2"]["name"] == "Beta"
    assert by(po.margin_bands(tables), "project_id")["P3"] == {
        "project_id": "P3", "bid_band": "red", "realized_band": "red"}


def test_results_do_not_depend_on_partitioning_or_order(spark):
    tables = portfolio(spark)
    shuffled = {k: v.orderBy(v.columns[-1]).repartition(7) for k, v in tables.items()}
    for operator in (po.project_summaries, margin.margin_by_sov_line, alerts.risk_alerts):
        assert operator(tables).collect() == operator(shuffled).collect()
