"""Every registered query equals its DuckDB statement on the given tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from jobmargin.catalog import QUERIES
from oracle.queries import STATEMENTS

FOLDER = "/root/testdata/sf0.001"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(row[k] for k in order)) for row in rows)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    registered = set(entry_points.queries())
    assert set(QUERIES) <= registered and set(entry_points.oracle_sql()) <= registered


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_statement(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        view = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {view} AS SELECT * FROM '{path}'")
    result = db.execute(STATEMENTS[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    rows = [tuple(r) for r in frame.collect()]
    assert canonical(frame.columns, rows) == canonical(names, result.fetchall())
    assert rows


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
