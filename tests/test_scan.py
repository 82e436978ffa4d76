"""The carry of a sliced scan as a tree."""

import re

import pytest
from pyspark.sql import functions as F

from wattline.operators.scan import Scan, sliced_scan


def scans():
    return [Scan("best", F.when(F.col("v") % 3 == 0, F.struct("t", "v")), "max", "before", ("t", "v")),
            Scan("least", F.col("v"), "min", "after"), Scan("total", F.col("v"), "sum", "upto")]


@pytest.mark.parametrize("levels", [2, 3])
def test_tree_gives_what_one_window_gives(spark, levels, monkeypatch):
    import wattline.operators.scan as scan
    monkeypatch.setattr(scan, "SPREAD", 4)
    df = spark.range(600).select((F.col("id") % 2).alias("k"), (F.col("id") * 37 % 600).alias("t"), (F.xxhash64("id") % 50).alias("v"))
    df = df.withColumn("s", F.floor(F.col("t") / 3))
    one = sliced_scan(df, ["k"], "t", "s", scans(), totals=["total"])
    tree = sliced_scan(df, ["k"], "t", "s", scans(), totals=["total"], levels=levels)
    assert sorted(one.columns) == sorted(tree.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, tree.select(*one.columns).collect()))


def test_a_million_sparse_slices_of_one_series(spark):
    """As many slices as rows: windows hold a group of slices, or the groups' summaries, never the series."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("x").alias("k"), (F.col("id") * 1000).alias("t"), F.col("id").alias("s"), F.lit(1).cast("long").alias("v"))
    out = sliced_scan(df, ["k"], "t", "s", [Scan("y", F.col("v"), "sum", "before")], levels=2)
    assert out.where(F.col("y") != F.col("s")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    parts = [p.split("#")[0] for p in re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)]
    orders = re.findall(r"Window \[.*?\], \[.*?\], \[(.*?)\]", plan)
    for part, order in zip(re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan), orders):
        assert "_group2#" in part or "s#" in part or "_group2#" in order, (part, order)
    assert parts
