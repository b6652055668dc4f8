"""Typed CSV loading, the junction and writers."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jobmargin import catalog
from jobmargin.operators.adhoc import select_sql
from jobmargin.plans import earned_value as ev
from jobmargin.session import FREED, PARTITIONS
from jobmargin.sources import readers, writers
from jobmargin.sources.bridge import bridge
from jobmargin.sources.junction import co_impact_by_sov_line, co_sov_lines
from jobmargin.sources.schemas import TABLES
from tests.portfolio import by, portfolio


def put(folder, name, text):
    path = os.path.join(folder, f"{name}.csv")
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(text)
    return path


def test_columns_go_by_name_and_are_rounded(spark, tmp_path):
    path = put(tmp_path, "sov", "project_id,sov_line_id,line_number,description,scheduled_value,labor_pct,material_pct\n"
               "P1,P1-1,1,Duct,100.5,0.5930627524215177,0.4\n\n")
    row = readers.read_csv_table(spark, path, "sov").first()
    assert (row.sov_line_id, row.project_id, row.labor_pct) == ("P1-1", "P1", Decimal("0.5931"))
    assert readers.read_csv_table(spark, path, "sov").count() == 1
    assert readers.read_csv_table(spark, path, "sov").schema.names == TABLES["sov"].struct.names


def test_empty_is_null_and_text_keeps_blanks_quotes_and_lines(spark, tmp_path):
    path = put(tmp_path, "field_notes", 'note_id,project_id,date,author,note_type,content,photos_attached,weather\n'
               'N1,P1,2024-01-02, ,Daily Report,"said ""go""\nsecond, line",3,""\n')
    row = readers.read_csv_table(spark, path, "field_notes").first()
    assert row.author == " " and row.content == 'said "go"\nsecond, line'
    assert row.weather is None and row.temp_high is None and row.date == dt.date(2024, 1, 2)


def test_a_number_that_does_not_parse_fails_the_load(spark, tmp_path):
    path = put(tmp_path, "sov_budget", "sov_line_id,project_id,estimated_labor_hours,estimated_labor_cost,"
               "estimated_material_cost,estimated_equipment_cost,estimated_sub_cost,productivity_factor\nP1-1,P1,ten,1,1,1,1,1\n")
    with pytest.raises(PySparkException):
        readers.read_csv_table(spark, path, "sov_budget").collect()


@pytest.mark.parametrize("text, value", [
    ("true", True), ("TRUE", True), ("1", True), ("yes", False), ("", False), (None, False), ("0", False)])
def test_booleans_are_never_null(spark, text, value):
    df = spark.createDataFrame([(text,)], "x string").select(readers.text_to_bool(F.col("x")).alias("b"))
    assert df.first().b is value


def test_junction_skips_what_does_not_parse(spark):
    rows = {tuple(r) for r in co_sov_lines(portfolio(spark)).collect()}
    assert rows == {("P1", "CO-1", "P1-1"), ("P1", "CO-1", "P1-2"), ("P1", "CO-2", "P1-1")}
    impact = by(co_impact_by_sov_line(portfolio(spark)), "sov_line_id")
    assert (impact["P1-1"]["co_count"], impact["P1-1"]["co_amount"]) == (2, 70)


def test_csv_round_trip_of_all_file_tables(spark, tmp_path):
    tables = portfolio(spark)
    names = [n for n in tables if n != "change_order_sov_lines"]
    for name in names:
        writers.write_csv_table(tables[name], f"{tmp_path}/{name}.csv")
    loaded = readers.load_tables(spark, str(tmp_path), names, strict=False)
    for name in tables:
        assert sorted(map(repr, loaded[name].collect())) == sorted(map(repr, tables[name].collect())), name


def test_parquet_tables_are_clustered_and_prune_by_project(spark, tmp_path):
    tables = portfolio(spark)
    writers.write_tables(tables, str(tmp_path), ("labor_logs", "contracts"))
    back = readers.load_tables(spark, str(tmp_path), ("labor_logs", "contracts"), "parquet", strict=False)
    assert sorted(map(repr, back["labor_logs"].collect())) == sorted(map(repr, tables["labor_logs"].collect()))
    plan = back["labor_logs"].where("project_id = 'P1'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(project_id,P1)" in plan
    writers.write_table(tables["labor_logs"], f"{tmp_path}/parts", partition_by=("project_id",))
    assert spark.read.parquet(f"{tmp_path}/parts").where("project_id = 'P2'").count() == 2


SOV_HEAD = "project_id,sov_line_id,line_number,description,scheduled_value,labor_pct,material_pct\n"


def test_a_missing_required_column_or_value_fails_the_load(spark, tmp_path):
    path = put(tmp_path, "sov", SOV_HEAD.replace("project_id", "project") + "P1,P1-1,1,Duct,1,0,0\n")
    with pytest.raises(ValueError, match="project_id"):
        readers.read_csv_table(spark, path, "sov")
    path = put(tmp_path, "sov", SOV_HEAD + ",P1-1,1,Duct,1,0,0\n")
    with pytest.raises(PySparkException, match="sov.project_id is required"):
        readers.read_csv_table(spark, path, "sov").collect()
    assert readers.read_csv_table(spark, path, "sov", strict=False).first().project_id is None


def test_parquet_is_cast_and_checked(spark, tmp_path):
    loose = spark.createDataFrame(
        [("P1-1", "P1", 1, "Duct", "10.5", 0.25, 0.5)],
        "sov_line_id string, project_id string, line_number long, description string, scheduled_value string, labor_pct double, material_pct double")
    loose.write.parquet(f"{tmp_path}/a/sov")
    row = readers.load_tables(spark, f"{tmp_path}/a", ("sov",), "parquet")["sov"]
    assert row.dtypes == [(f.name, f.dataType.simpleString()) for f in TABLES["sov"].struct.fields]
    assert row.first().scheduled_value == Decimal("10.50")
    loose.drop("project_id").write.parquet(f"{tmp_path}/b/sov")
    with pytest.raises(ValueError, match="project_id"):
        readers.load_tables(spark, f"{tmp_path}/b", ("sov",), "parquet")
    loose.withColumn("project_id", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/c/sov")
    with pytest.raises(PySparkException, match="is required"):
        readers.load_tables(spark, f"{tmp_path}/c", ("sov",), "parquet")["sov"].collect()


def test_the_bridge_is_a_whole_mapping(spark, tmp_path):
    tables = bridge(spark, "/root/testdata/sf0.001")
    assert list(tables) == list(TABLES) and len(tables) == 12 and "sov" in tables and "other" not in tables
    writers.write_tables(tables, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted(TABLES)


def test_select_sees_all_tables_and_leaves_own_views(spark):
    tables = portfolio(spark)
    spark.range(3).createOrReplaceTempView("sov")
    found = select_sql(spark, tables, "SELECT count(*) AS n FROM sov JOIN contracts USING (project_id)")
    assert found.first().n == tables["sov"].count()
    assert spark.table("sov").count() == 3 and not spark.catalog.tableExists("contracts")
    spark.catalog.dropTempView("sov")


def test_facts_are_written_in_a_step_of_their_own(spark, monkeypatch):
    """Shuffle files of the written fact are deleted before it is read back, and its shuffles follow the input."""
    seen, write = [], writers.write_facts

    def writing(facts, path):
        seen.append(tuple(spark.conf.get(name) for name in (FREED, PARTITIONS)))
        write(facts, path)

    monkeypatch.setattr(writers, "write_facts", writing)
    monkeypatch.setattr(ev, "SHARE", 4096)
    rows = catalog.read_fact_week(spark, "/root/testdata/sf0.001").count()
    assert rows > 0 and seen[0][0] == "true" and int(seen[0][1]) > 4
    assert (spark.conf.get(FREED), spark.conf.get(PARTITIONS)) == ("false", "4")
