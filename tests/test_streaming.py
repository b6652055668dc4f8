"""Streams against their batch forms, and late entries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobmargin.plans import earned_value as ev
from jobmargin.streaming import labor as stream
from jobmargin.streaming.runner import latest_state, result_of, run_updates
from tests.portfolio import by, portfolio


def write_batches(spark, tables, folder, batches):
    """One file per batch of log ids, in this order of time."""
    for number, ids in enumerate(batches):
        rows = tables["labor_logs"].where(F.col("log_id").isin(ids)).coalesce(1)
        rows.write.mode("append").parquet(f"{folder}/{number:03d}")


def open_stream(spark, tables, folder):
    schema = tables["labor_logs"].schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_weekly_stream_equals_batch(spark, tmp_path):
    tables = portfolio(spark)
    ids = [r.log_id for r in tables["labor_logs"].select("log_id").orderBy("log_id").collect()]
    write_batches(spark, tables, tmp_path, [ids[:3], ids[4:], ids[3:4]])
    weekly = stream.stream_labor_week(open_stream(spark, tables, tmp_path), "1000 days")
    streamed = result_of(weekly, ev.LINE_WEEK, "test-weekly")
    batch = ev.labor_week_uncut(tables).select(*streamed.columns)
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, batch.collect()))


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_weeks_do_not_depend_on_the_time_zone(spark, tmp_path, zone):
    tables = portfolio(spark)
    write_batches(spark, tables, tmp_path, [["LOG-1", "LOG-2", "LOG-3"]])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        weekly = stream.stream_labor_week(open_stream(spark, tables, tmp_path))
        rows = result_of(weekly, ev.LINE_WEEK, "test-zone").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {(r.sov_line_id, r.week_end) for r in rows} == {
        ("P1-1", dt.date(2024, 1, 7)), ("P1-2", dt.date(2024, 1, 14))}


def test_late_entries_are_dropped(spark, tmp_path):
    """The watermark of one batch filters the next but one."""
    tables = portfolio(spark)
    write_batches(spark, tables, tmp_path, [["OVR-4"], ["LOG-3"], ["LOG-1"]])
    weekly = stream.stream_labor_week(open_stream(spark, tables, tmp_path), "14 days")
    rows = by(result_of(weekly, ev.LINE_WEEK, "test-late"), "sov_line_id", "week_end")
    assert ("P1-2", dt.date(2025, 1, 5)) in rows
    assert ("P1-1", dt.date(2024, 1, 7)) not in rows


def test_overrun_alerts_follow_the_running_total(spark, tmp_path):
    tables = portfolio(spark)
    write_batches(spark, tables, f"{tmp_path}/in", [["LOG-1"], ["LOG-2", "LOG-3"], ["OVR-4", "LOG-5"]])
    alerts = stream.stream_overrun_alerts(open_stream(spark, tables, f"{tmp_path}/in"), tables["sov_budget"])
    run_updates(alerts, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    updates = spark.read.parquet(f"{tmp_path}/out")
    assert [r.actual_labor_cost for r in updates.where("open").orderBy("batch_id").collect()] == [650]
    final = by(latest_state(updates, ["project_id"]).where("open"), "project_id")
    assert set(final) == {"P1"} and final["P1"]["overrun"] == 150


def test_a_correction_closes_an_alert(spark, tmp_path):
    tables = portfolio(spark)
    entry = tables["labor_logs"].where("project_id = 'P1'").limit(1)
    for number, hours in enumerate((10, 10, -15)):
        changed = entry.select(*[F.lit(value).cast(entry.schema[name].dataType).alias(name) if (value := {
            "hours_st": hours, "hours_ot": 0, "hourly_rate": 100, "burden_multiplier": 1, "log_id": f"X{number}"}.get(name)) is not None
            else F.col(name) for name in entry.columns])
        changed.coalesce(1).write.parquet(f"{tmp_path}/in/{number:03d}")
    budget = spark.createDataFrame([("P1", 1000)], "project_id string, cost int").select(
        "project_id", F.col("cost").cast("decimal(12,2)").alias("estimated_labor_cost"))
    alerts = stream.stream_overrun_alerts(open_stream(spark, tables, f"{tmp_path}/in"), budget)
    run_updates(alerts, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    updates = spark.read.parquet(f"{tmp_path}/out")
    assert [r.open for r in updates.orderBy("batch_id").collect()] == [False, True, False]
    assert latest_state(updates, ["project_id"]).where("open").count() == 0
