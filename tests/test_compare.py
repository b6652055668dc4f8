"""Comparison of two loads against sets of rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobmargin.sources import compare

SCHEMA = "key string, part int, amount decimal(12,2), note string"


def plain(before, after):
    def by_key(rows):
        out = {}
        for row in rows:
            out.setdefault(row[:2], Counter())[row[2:]] += 1
        return out

    old, new = by_key(before), by_key(after)
    change = lambda k: "inserted" if k not in old else "deleted" if k not in new else "changed"
    return sorted(((*k, change(k)) for k in old.keys() | new.keys() if old.get(k) != new.get(k)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def loads(spark):
    """Keys with nulls, repeated rows, and a value that moves from one column to another."""
    rng = random.Random(2)
    before = [(f"k{i}", i % 3, None if i % 7 == 0 else i, rng.choice([None, "a", "b"])) for i in range(400)]
    before += [(None, None, 1, "x"), ("twice", 1, 5, None), ("twice", 1, 5, None), ("moved", 1, None, "5")]
    after = [(k, p, a if i % 50 else (a or 0) + 1, n) for i, (k, p, a, n) in enumerate(before) if i % 41]
    after += [("new", 1, 1, None), ("twice", 1, 5, None), (None, 2, 1, "x")]
    make = lambda rows: spark.createDataFrame(rows, "key string, part int, amount int, note string").repartition(3)
    return before, after, make(before), make(after)


def test_changes_by_key(spark):
    before, after, old, new = loads(spark)
    expected = plain(before, after)
    assert {c for *_, c in expected} == {"inserted", "deleted", "changed"}
    assert got(compare.compare_loads(old, new.select(*reversed(new.columns)), ["key", "part"])) == expected
    assert got(compare.compare_loads(old, old, ["key", "part"])) == []
    assert got(compare.compare_loads(old.limit(0), old, ["key", "part"])) == plain([], before)
    with pytest.raises(ValueError, match="same columns"):
        compare.compare_loads(old, new.drop("note"), ["key", "part"])


def test_only_leaves_that_differ_are_compared(spark, tmp_path):
    """With stored digests; rows of other leaves are not there at all, and are not missed."""
    before, after, old, new = loads(spark)
    keys = ["key", "part"]
    for name, rows in (("old", old), ("new", new)):
        compare.load_digests(rows, keys).write.parquet(f"{tmp_path}/{name}")
    digests = tuple(spark.read.parquet(f"{tmp_path}/{name}") for name in ("old", "new"))
    leaves = {r.leaf for r in compare.differing_leaves(*digests).collect()}
    changed = {r.leaf for r in spark.createDataFrame([c[:2] for c in plain(before, after)], "key string, part int").select(
        compare.leaf_of(keys).alias("leaf")).collect()}
    assert leaves == changed and len(leaves) < 60
    inside = compare.leaf_of(keys).isin(sorted(leaves))
    assert got(compare.compare_loads(old.where(inside), new.where(inside), keys, digests)) == plain(before, after)


def test_a_null_is_no_value(spark):
    """A value that moves to another column changes the row's hash."""
    rows = spark.createDataFrame([("a", 1, None, "5"), ("a", 1, "5", None)], "key string, part int, amount string, note string")
    assert rows.select(compare.row_hash(rows.columns).alias("h")).agg(F.count_distinct("h")).first()[0] == 2
