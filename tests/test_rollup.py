"""Roll-up of labor over the hierarchy against plain groups."""

import statistics

from jobmargin.catalog import QUERIES
from jobmargin.plans import rollup
from tests.portfolio import portfolio


def plain(rows):
    groups = {}
    for r in rows:
        keys = (r.project_id, r.sov_line_id, r.week_end)
        for level in range(4):
            groups.setdefault((rollup.LEVELS[level], *(k if n < level else None for n, k in enumerate(keys))), []).append(r)
    return {key: (len(own), float(sum(r.hours for r in own)), float(sum(r.cost for r in own)), statistics.median(float(r.cost) for r in own)) for key, own in groups.items()}


def entries(tables):
    from jobmargin.functions import measures as m
    from jobmargin.functions.dates import week_end_sunday

    return tables["labor_logs"].select("project_id", "sov_line_id", week_end_sunday("date").alias("week_end"), m.labor_hours().alias("hours"), m.labor_cost().alias("cost")).collect()


def got(tables):
    return {(r.level, r.project_id, r.sov_line_id, r.week_end): (r.entries, r.hours, r.cost, r.median_cost) for r in rollup.labor_rollup(tables).collect()}


def test_levels_of_the_small_portfolio(spark):
    tables = portfolio(spark)
    assert got(tables) == plain(entries(tables))


def test_medians_do_not_depend_on_the_buckets(spark, monkeypatch):
    """Repeated costs, one week with most entries, and one, three or many buckets."""
    labor = [f"L{k},P{1 + k % 2},2024-01-{1 + (k * k) % 27:02d},L-{k % 5 % 2},{1 + (k * 7) % 13 % (3 + k % 9)},0,10,1,1" for k in range(400)]
    tables = portfolio(spark, labor_logs=labor)
    expected = plain(entries(tables))
    for buckets in (1, 3, 256):
        monkeypatch.setattr(rollup, "BUCKETS", buckets)
        assert got(tables) == expected


def test_buckets_of_blocks(spark):
    """A cost's bucket is the number of edges at or below it, in whichever block they lie."""
    from bisect import bisect_right
    from decimal import Decimal

    costs = [None, *(Decimal(k) / 4 for k in range(-4, 300))]
    rows = spark.createDataFrame([(c,) for c in costs], "entry_cost decimal(22,6)")
    for n in (0, 1, 15, 16, 17, 33, 60):
        edges = [Decimal(k) for k in range(n)]
        placed = rows.select("entry_cost", rollup._bucket(edges, rows.schema["entry_cost"].dataType).alias("bucket")).collect()
        assert all(r.bucket == (0 if r.entry_cost is None else bisect_right(edges, r.entry_cost)) for r in placed)


def test_only_buckets_of_several_values_are_put_in_order(spark, monkeypatch):
    """Middles of one value are known from the counts; the values of the others alone are dealt to their groups."""
    labor = [f"L{k},P{1 + k % 2},2024-01-{1 + (k * k) % 27:02d},L-{k % 5 % 2},{1 + k % 6},0,10,1,1" for k in range(120)]
    tables, dealt, middle_values = portfolio(spark, labor_logs=labor), [], rollup._middle_values
    monkeypatch.setattr(rollup, "_middle_values", lambda *args: dealt.append(middle_values(*args)) or dealt[-1])
    expected = plain(entries(tables))
    for buckets, several in ((256, False), (1, True)):
        monkeypatch.setattr(rollup, "BUCKETS", buckets)
        assert got(tables) == expected
        assert (dealt[-1].count() > 0) == several


def test_no_entries(spark):
    tables = portfolio(spark)
    assert rollup.labor_rollup({**tables, "labor_logs": tables["labor_logs"].limit(0)}).count() == 0


def test_plan(spark):
    text = QUERIES["labor_rollup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
