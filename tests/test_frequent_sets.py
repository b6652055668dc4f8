"""Frequent sets against counting every combination."""

import random
from collections import Counter
from itertools import combinations

import pytest

from jobmargin.plans import leaks


@pytest.mark.parametrize("least, largest", [(3, 4), (8, 3), (1, 2), (60, 3)])
def test_sets_against_all_combinations(spark, least, largest):
    rng = random.Random(least)
    holders = {f"P{k}": {f"w{i}" for i in range(9) if rng.random() < (0.9 if i < 3 else 0.25)} for k in range(50)}
    rows = [(p, w) for p, own in holders.items() for w in own for _ in range(rng.choice([1, 1, 3]))] + [("P0", None), (None, "w1")]
    counts = Counter(" + ".join(c) for own in holders.values() for size in range(2, largest + 1) for c in combinations(sorted(own), size))
    frame = spark.createDataFrame(rows, "project string, work string").repartition(3)
    got = {r["items"]: (r["size"], r["holders"]) for r in leaks.frequent_sets(frame, "project", "work", least, largest).collect()}
    assert got == {items: (items.count("+") + 1, n) for items, n in counts.items() if n >= least}
    assert leaks.frequent_sets(frame.limit(0), "project", "work", least, largest).count() == 0
