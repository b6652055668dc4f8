import datetime
import re

from jobmargin.plans import earned_value as ev
from jobmargin.sources import bridge as views


def partitions(df, key):
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    return {int(n) for n in re.findall(rf"hashpartitioning\({key}#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)}


def test_parts_follow_the_input(spark, tmp_path, monkeypatch):
    """Windows over billed months and weekly facts get partitions by the bytes of the input, not by a fixed setting."""
    day = datetime.datetime(1996, 3, 4)
    items = [(k, k % 9, k % 5 if k % 7 else None, 1 + k % 3, 10.0, 100.0 + k, 0.05, 0.02, "ANR"[k % 3], "O", day + datetime.timedelta(k)) for k in range(60)]
    spark.createDataFrame(
        [*items, items[3]], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, k, "F", 1.0, day + datetime.timedelta(3 * k), "5-LOW") for k in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(
        f"{tmp_path}/orders.parquet")

    def results():
        tables = views.bridge(spark, str(tmp_path))
        frames = [tables["billing_history"], ev.fact_line_week(tables)]
        return frames, [sorted(map(str, df.collect())) for df in frames]

    before, usual = results()
    few = max(partitions(before[1], "project_id"))
    monkeypatch.setattr(views, "SHARE", 100)
    monkeypatch.setattr(ev, "SHARE", 10)
    after, many = results()
    assert many == usual and all(usual)
    assert max(partitions(after[0], "l_suppkey")) >= 30
    assert max(partitions(after[1], "project_id")) > few
