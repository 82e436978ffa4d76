"""Plan guards for scale: no window over raw rows is partitioned by the series
alone (a hot device would be one task); series-only windows are allowed only
over per-slice summaries, which are ordered by a slice column."""
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SLICE = re.compile(r"(tslice|_aslice|_tslice|_slice)#")


def windows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    # "Window [exprs], [partition keys], [order keys]"
    return re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", plan)


@pytest.mark.parametrize("name", ["w12_measurements", "h3_all_buildings_chart", "j2_asof_backward",
                                  "w9_rolling_sum", "o6_latest_per_series"])
def test_no_series_only_window_over_rows(spark, name):
    found = windows(E.queries()[name](spark, SF))
    assert found, name
    for part, order in found:
        keys = {k.split("#")[0] for k in part.split(", ") if k}
        # Catalyst drops a constant metric from the keys, so any subset counts.
        if keys <= {"device_id", "metric"}:
            assert SLICE.search(order), (name, part, order)
        assert keys != {"label"}, (name, part, order)  # rolling is sliced by time too
        assert keys, (name, part, order)  # never one window over everything


def test_time_groups_use_hash_aggregation(spark):
    plan = E.queries()["w12_measurements"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    agg = [line for line in plan.splitlines() if "min_by(value" in line]
    assert agg and all("HashAggregate" in line for line in agg)


def test_stored_device_read_is_pruned(spark):
    import glob
    import tempfile

    from wattline.sources.batches import load_measurements, write_measurements
    path = tempfile.mkdtemp(prefix="wl-stored-")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    write_measurements(E._m(spark, SF), path, buckets=8)
    df = load_measurements(spark, path, E.DEVICE, start=E.RANGE_START, end=E.RANGE_END, buckets=8)
    plan = _plan(df)
    scan = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    assert "bucket" in scan and "event_month" in scan
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "device_id" in pushed and "ts" in pushed
    assert len(df.inputFiles()) > 0
    read = {r[0] for r in df.select("*").withColumn("f", F.input_file_name()).select("f").distinct().collect()}
    assert 0 < len(read) <= 2 < len(glob.glob(f"{path}/bucket=*/event_month=*/*.parquet"))


def test_chart_and_listing_shuffles(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert _shuffles(E.queries()["h3_all_buildings_chart"](spark, SF)) <= 12
    assert _shuffles(E.queries()["a9_buildings"](spark, SF)) <= 2


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _shuffles(df):
    """Shuffles of the plan that ran (reused ones count once)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(line.lstrip(" :+-").startswith("Exchange ") for line in plan.splitlines())
