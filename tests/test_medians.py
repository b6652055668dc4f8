"""The bracketed median equals the plain one."""

import random
import statistics

import pytest

from jobmargin.functions.medians import median_of_large_groups


@pytest.mark.parametrize("size", [1, 2, 3, 10, 5001, 20000])
def test_equals_plain_median(spark, size):
    rng = random.Random(size)
    groups = {
        "spread": [rng.uniform(-5, 5) for _ in range(size)],
        "ties": [float(rng.choice([1, 1, 1, 2])) for _ in range(size)],
        "one": [7.5] * size,
        "skewed": [rng.paretovariate(0.5) for _ in range(size)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r.g: r.med for r in median_of_large_groups(df, "g", "v", "med").collect()}
    assert set(found) == set(groups)
    for group, values in groups.items():
        assert found[group] == pytest.approx(statistics.median(values), abs=1e-12)
