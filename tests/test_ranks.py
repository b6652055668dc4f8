"""Ranks and shared scratch."""

import pytest
from pyspark.sql import functions as F

from jobmargin import session
from jobmargin.operators import margin


def test_ranks_far_out_and_close_together(spark, monkeypatch):
    deltas = [-5000.0, -4999.9999999, -80.0, -80.0, -0.1, -0.1 + 1e-9, 0.0, 3.0, 77.0] + [k / 7 for k in range(300)]
    rows = [(f"P{k:04d}", f"name {k}", 0.0, d, d) for k, d in enumerate(deltas)]
    frame = spark.createDataFrame(rows, "project_id string, project_name string, bid_margin double, realized_margin double, margin_delta double")
    monkeypatch.setattr(margin, "_project_margins", lambda tables: frame)
    got = {r.project_id: r.margin_rank for r in margin.margin_rank({}).collect()}
    assert got == {row[0]: 1 + sum(d < row[4] for d in deltas) for row in rows}
    monkeypatch.setattr(margin, "_project_margins", lambda tables: frame.limit(0))
    assert margin.margin_rank({}).count() == 0


class Elsewhere:
    """A session of a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"


def test_no_machine_local_scratch_on_a_cluster(spark):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Elsewhere, "x")
    Elsewhere.sparkContext.master = "local[4]"
    assert session.shared_folder(Elsewhere, "x").startswith(session.LOCAL_FOLDER)
    kept = session.materialise(spark.range(5).select(F.col("id")), "test")
    assert kept.count() == 5
