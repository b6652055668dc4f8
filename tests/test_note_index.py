"""The note index against the scan, its files, and its life."""

import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from jobmargin.operators import notes
from jobmargin.session import FREED
from jobmargin.sources import note_index
from tests.portfolio import portfolio

WORDS = ["rain", "delay", "pipe", "duct", "Über", "zone"]


def many_notes(spark, n, start=0):
    """Every note holds `all`; other words come at different rates."""
    rows = []
    for i in range(start, start + n):
        words = ["all", *(w for k, w in enumerate(WORDS) if i % (k + 2) == 0)]
        rows.append((f"N{i}", f"P{1 + i % 3}", None, "Daily Report", " ".join(words)))
    return spark.createDataFrame(rows, "note_id string, project_id string, date date, note_type string, content string")


def ids(df):
    return sorted(r.note_id for r in df.select("note_id").collect())


def both(spark, tables, words, path):
    return ids(notes.field_notes_token_search(tables, words, path)), ids(notes.field_notes_token_search(tables, words))


def test_search_equals_the_scan_through_additions_and_compaction(spark, tmp_path):
    path = str(tmp_path / "index")
    tables = dict(portfolio(spark), field_notes=many_notes(spark, 400))
    note_index.write_note_index(tables["field_notes"].where("substring(note_id, 2) < '2'"), path, block=16)
    note_index.add_notes(tables["field_notes"], path, block=8)              # most of them are new
    cases = [["all"], ["all", "rain"], ["RAIN", "über"], ["pipe", "duct", "zone"], ["all", *WORDS], ["nowhere"], ["all", "nowhere"]]
    for words in cases:
        found, scanned = both(spark, tables, words, path)
        assert found == scanned
        assert bool(found) == ("nowhere" not in words)
    note_index.add_notes(tables["field_notes"], path)                       # nothing new
    assert ids(note_index.indexed_notes(spark, path)) == ids(tables["field_notes"])
    note_index.compact(spark, path, block=32)
    assert note_index.live_generations(spark, path) == [3]
    for words in cases:
        assert len(set(map(tuple, both(spark, tables, words, path)))) == 1
    counts = {r.token: r.n_notes for r in note_index.token_counts(spark, path).collect()}
    assert counts["all"] == 400 and counts["rain"] == 200


def test_only_the_folders_of_the_words_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    note_index.write_note_index(many_notes(spark, 300), path, block=16)
    lists = note_index.postings(spark, path, ["rain", "all"])
    rows = lists.collect()
    scan = lists._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = scan.metrics().get("numFiles").get().value()
    written = sum(f.endswith(".parquet") for _, _, files in os.walk(f"{path}/postings") for f in files)
    assert 1 <= read <= 4 < written                                         # files of two folders of seven
    assert max(len(r.notes) for r in rows) < 60                             # `all` is many lists, not one of 300
    text = note_index.search(spark, path, ["rain", "all"])._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert bad not in text


def test_unfinished_generations_do_not_count(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError, match="No note index"):
        note_index.search(spark, path, ["rain"]).collect()
    note_index.write_note_index(many_notes(spark, 20), path)
    half = many_notes(spark, 20, 20).withColumn("block", F.lit(0).cast("bigint"))
    half.withColumn("segment", F.lit(0)).write.partitionBy("segment").parquet(f"{path}/notes/generation=1")
    assert len(ids(note_index.search(spark, path, ["all"]))) == 20
    note_index.add_notes(many_notes(spark, 20, 20), path)                   # the same generation again, whole
    assert len(ids(note_index.search(spark, path, ["all"]))) == 40


def test_empty_and_missing_values(spark, tmp_path):
    path = str(tmp_path / "index")
    note_index.write_note_index(many_notes(spark, 0), path)
    assert note_index.search(spark, path, ["rain"]).count() == 0
    rows = [("A", "P1", None, None, None), (None, "P1", None, None, "rain"), ("B", "P2", None, None, ""), ("C", None, None, None, "rain rain, RAIN")]
    note_index.add_notes(spark.createDataFrame(rows, many_notes(spark, 0).schema), path)
    assert ids(note_index.search(spark, path, ["rain"])) == ["C"]
    assert ids(note_index.indexed_notes(spark, path)) == ["A", "B", "C"]


def test_lists_are_made_of_the_written_notes_in_one_exchange(spark, tmp_path, monkeypatch):
    """The work behind added notes is not done again for their postings, and words are not dealt a second time for the folders."""
    plans, parquet = {}, DataFrameWriter.parquet

    def seen(self, path, *args, **kwargs):
        plans[path[len(str(tmp_path)):]] = self._df._jdf.queryExecution().executedPlan().toString()
        assert spark.conf.get(FREED) == "true" or "/commits/" in path
        parquet(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    path = str(tmp_path / "index")
    note_index.write_note_index(many_notes(spark, 300), path, block=16)
    note_index.add_notes(many_notes(spark, 200, 200), path, block=16)
    note_index.compact(spark, path)
    assert spark.conf.get(FREED) == "false"
    for generation in range(3):
        text = plans[f"/index/postings/generation={generation}"]
        assert text.count("Exchange ") == 1 and "FileScan" in text and "ExistingRDD" not in text and "Join" not in text
    counts = {r.token: r.n_notes for r in note_index.token_counts(spark, path).collect()}
    assert counts["all"] == 400 and counts["rain"] == 200
