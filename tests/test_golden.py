"""Published totals and identities, from inline frames."""

import pytest
from pyspark.sql import functions as F

from jobmargin.functions import measures as m
from jobmargin.operators import changes

# Published per-project totals and the margins and limits that follow from them.
PROJECTS = ("001", "002", "003", "004", "005")
BID_COST = (3_472_590, 3_114_350, 557_370, 1_677_380, 1_392_410)
BID_MARGIN = (0.901330, 0.897080, 0.899464, 0.897345, 0.897992)
BILLED = (34_955_400, 30_075_400, 5_500_700, 16_205_800, 13_556_100)
REALIZED = (0.499507, 0.429229, 0.256544, 0.459829, 0.399122)
CONTRACT_TOTAL, BID_TOTAL, BILLED_TOTAL = 100_988_000, 10_214_100, 100_293_400
STATUSES = {"Approved": (45, 15_166_200), "Pending": (3, 74_400), "Under Review": (1, 34_800), "Rejected": (19, 6_166_500)}
REASONS = {
    "Owner Request": (13, 6_370_800), "Design Error": (11, 2_921_200), "Unforeseen Condition": (10, 2_440_800),
    "Code Compliance": (10, 3_221_300), "Scope Gap": (9, 5_642_400), "Coordination": (7, 1_525_200),
    "Value Engineering": (5, -1_186_100), "Acceleration": (3, 506_300),
}


def test_totals_agree_with_each_other():
    assert sum(BID_COST) == BID_TOTAL and sum(BILLED) == BILLED_TOTAL
    assert sum(n for n, _ in STATUSES.values()) == sum(n for n, _ in REASONS.values()) == 68
    assert sum(a for _, a in STATUSES.values()) == sum(a for _, a in REASONS.values())


def test_bid_margins(spark):
    """Contract values follow from bid cost and margin; their total is published."""
    values = [round(cost / (1 - share), -3) for cost, share in zip(BID_COST, BID_MARGIN)]
    assert sum(values) == pytest.approx(CONTRACT_TOTAL, abs=5000)
    df = spark.createDataFrame(list(zip(PROJECTS, values, map(float, BID_COST))), "p string, v double, b double")
    dec = [F.col(c).cast("decimal(15,2)") for c in "vb"]
    for row, share in zip(df.select("p", m.bid_margin(*dec).alias("x")).orderBy("p").collect(), BID_MARGIN):
        assert row.x == pytest.approx(share, abs=2e-5)


def test_realized_margins(spark):
    costs = [billed * (1 - share) for billed, share in zip(BILLED, REALIZED)]
    df = spark.createDataFrame(list(zip(PROJECTS, map(float, BILLED), costs)), "p string, billed double, c double")
    dec = [F.col(c).cast("decimal(15,2)") for c in ("billed", "c")]
    for row, share in zip(df.select("p", m.realized_margin(*dec).alias("x")).orderBy("p").collect(), REALIZED):
        assert row.x == pytest.approx(share, abs=1e-6)


def spread(groups, column):
    """Rows whose counts and sums are the published ones."""
    rows = []
    for name, (n, total) in groups.items():
        rows += [(f"{name}{k}", name, float(total // n + (total % n if k == 0 else 0))) for k in range(n)]
    return rows, f"co_number string, {column} string, amount double"


def change_orders(spark, groups, column):
    rows, shape = spread(groups, column)
    frame = spark.createDataFrame(rows, shape).withColumns({
        "amount": F.col("amount").cast("decimal(12,2)"), "project_id": F.lit("P"),
        **({"status": F.lit("Approved")} if column != "status" else {"reason_category": F.lit("x")}),
    })
    return {"change_orders": frame, "contracts": spark.createDataFrame([("P", "name")], "project_id string, project_name string")}


def test_change_orders_by_status(spark):
    row = changes.co_status_summary(change_orders(spark, STATUSES, "status")).first()
    pending = STATUSES["Pending"][1] + STATUSES["Under Review"][1]
    assert (row.total, row.approved_count, row.pending_count, row.rejected_count) == (68, 45, 4, 19)
    assert (row.approved_amount, row.pending_amount, row.rejected_amount) == (15_166_200, pending, 6_166_500)


def test_change_orders_by_reason(spark):
    rows = changes.co_reason_summary(change_orders(spark, REASONS, "reason_category")).collect()
    found = {row.reason: (int(row["co_count"]), round(float(row["total_amount"]))) for row in rows}
    assert found == REASONS


def test_scaled_variance_identity(spark):
    """Labor variance summed over a project: cost - scale x budget."""
    from jobmargin.plans import earned_value as ev
    from tests.portfolio import portfolio

    tables = portfolio(spark)
    lines = ev.scaled_variance(tables)
    sums = lines.groupBy("project_id").agg(
        F.sum("var_labor_scaled").alias("variance"), F.sum("labor_cost_td").cast("double").alias("cost"),
        F.max("labor_scale").alias("scale"), F.sum("estimated_labor_cost").cast("double").alias("budget")).collect()
    assert sums
    for row in sums:
        if row.scale is not None:
            assert float(row.variance) == pytest.approx(row.cost - row.scale * row.budget, abs=1e-6)
