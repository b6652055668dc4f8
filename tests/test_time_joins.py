"""Joins by time against loops over all pairs."""

import datetime as dt
import random

import pytest

from jobmargin.catalog import QUERIES
from jobmargin.operators import billing, labor
from jobmargin.plans import intervals
from tests.portfolio import by, portfolio

DAY = dt.date(1969, 6, 1)


def day(rng, spread):
    return DAY + dt.timedelta(days=rng.randrange(spread)) if rng.random() > 0.05 else None


@pytest.mark.parametrize("weeks, hot", [(1, 3), (13, 3), (13, 100_000), (40, 1)])
def test_periods_hold_their_days(spark, weeks, hot):
    """Days before 1970, null dates and keys, ends turned round, one key with most rows."""
    rng = random.Random(weeks)
    key = lambda: rng.choice(["a", "a", "a", "b", None])
    dated = [(key(), f"n{k}", day(rng, 500)) for k in range(150)]
    periods = [(key(), k, start, start and start + dt.timedelta(days=rng.choice([-3, 0, 6, 30, 200]))) for k in range(40) for start in [day(rng, 500)]]
    points = spark.createDataFrame(dated, "key string, note string, at date")
    spans = spark.createDataFrame(periods, "key string, period int, start date, end date")
    got = intervals.join_in_periods(points, spans, ["key"], "at", "start", "end", "note", weeks, hot)
    expected = sorted((n, p) for k, n, d in dated for j, p, s, e in periods if k == j and None not in (k, d, s) and s <= d <= e)
    assert sorted((r.note, r.period) for r in got.collect()) == expected and expected
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert intervals.join_in_periods(points.limit(0), spans, ["key"], "at", "start", "end", "note").count() == 0


def test_as_of_join(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), k, day(rng, 60)) for k in range(120)]
    states = [(rng.choice("ab"), day(rng, 60), k, k if rng.random() > 0.2 else None) for k in range(30)]
    left = spark.createDataFrame(rows, "key string, id int, at date").repartition(3)
    right = spark.createDataFrame(states, "key string, since date, number int, value int").repartition(3)
    met = intervals.as_of_join(left, right, ["key"], "at", "since", "number")
    assert met.columns == ["key", "id", "at", "since", "number", "value"]
    found = met.collect()
    assert len(found) == len(rows)
    for r in found:
        past = [(s, n, v) for k, s, n, v in states if k == r.key and s is not None and r.at is not None and s <= r.at]
        assert (r.since, r.number, r.value) == (max(past, key=lambda x: x[:2]) if past else (None, None, None))
    met = intervals.as_of_join(left, right, ["key"], "at", "since", "number")
    text = met._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(key") == 1 and "Join" not in text


def test_a_correction_ends_a_period_and_a_later_one_begins(spark):
    entry = "L{},P1,{},P1-1,{},0,100,1,1"          # budget 300, over from 330 on
    weeks = [(1, "2024-01-03", 4), (2, "2024-01-10", 1), (3, "2024-01-17", -3), (4, "2024-01-24", 1), (5, "2024-02-05", 1)]
    tables = portfolio(spark, labor_logs=[entry.format(*w) for w in weeks], field_notes=[
        "N1,P1,2024-01-07,Daily Report,rain", "N2,P1,2024-01-08,Daily Report,rain", "N3,P1,2024-01-15,Daily Report,rain",
        "N4,P1,2024-02-11,Daily Report,rain", "N5,P1,2024-02-12,Daily Report,rain", "N6,P2,2024-01-07,Daily Report,rain"])
    periods = [(r.over_from, r.over_to, r.overrun) for r in labor.overrun_periods(tables).orderBy("over_from").collect()]
    assert periods == [(dt.date(2024, 1, 1), dt.date(2024, 1, 14), 200.0), (dt.date(2024, 2, 5), dt.date(2024, 2, 11), 100.0)]
    notes = labor.overrun_period_notes(tables).collect()
    assert [(r.note_id, r.over_to) for r in notes] == [
        ("N1", dt.date(2024, 1, 14)), ("N2", dt.date(2024, 1, 14)), ("N4", dt.date(2024, 2, 11))]


def test_labor_weeks_with_the_application_in_force(spark):
    rows = by(billing.labor_week_billing(portfolio(spark)), "sov_line_id", "week_end")
    first, last = rows["P1-1", dt.date(2024, 1, 7)], rows["P1-2", dt.date(2025, 1, 5)]
    assert (first["application_number"], first["unbilled"]) == (None, 450.0)
    assert (last["application_number"], last["total_billed"], last["labor_cost_td"], last["unbilled"]) == (2, 80.0, 200.0, 120.0)


@pytest.mark.parametrize("name", ["overrun_period_notes", "labor_week_billing"])
def test_plans(spark, name):
    text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "NestedLoop", "Python"):
        assert bad not in text
