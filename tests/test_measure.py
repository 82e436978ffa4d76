import pytest
from pyspark.sql import functions as F

import fixtures as fx
from wattline.operators.measure import derive_measurements
from wattline.plans import queries as q

MODES = ["event_time", "arrival"]


def rows(m, *cols):
    return [tuple(r) for r in m.orderBy("ts", "arrival_seq").select(*cols).collect()]


@pytest.mark.parametrize("mode", MODES)
def test_duplicate_in_one_batch(spark, mode):
    m = derive_measurements(fx.series_rows(spark, [(0, 0, "kWh"), (5, 10, "kWh"), (5, 10, "kWh")]), mode)
    assert rows(m, "delta", "is_duplicate") == [(None, False), (10.0, False), (None, True)]
    assert q.series(m, m.first()["device_id"]).count() == 2


@pytest.mark.parametrize("mode", MODES)
def test_late_repair(spark, mode):
    arr = [(0, 10, "kWh"), (10, 20, "kWh"), (20, 25, "kWh"), (30, 30, "kWh")]
    before = derive_measurements(fx.series_rows(spark, arr), mode)
    assert [r[0] for r in rows(before, "delta")] == [None, 10.0, 5.0, 5.0]
    after = derive_measurements(fx.series_rows(spark, arr + [(5, 15, "kWh")]), mode)
    assert rows(after, "delta", "is_late") == [(None, False), (5.0, True), (5.0, False), (5.0, False), (5.0, False)]
    for m in (before, after):
        assert q.sum_deltas(m).first()[0] == 20.0


@pytest.mark.parametrize("mode", MODES)
def test_totals_exclude_bad(spark, mode):
    m = derive_measurements(fx.series_rows(spark, [(0, 0, "kWh"), (10, 10, "kWh"), (20, 20, "kWh"), (30, 999, "kals")]), mode)
    assert q.sum_deltas(m).first()[0] == 20.0
    assert q.series(m, m.first()["device_id"], exclude_bad="false").count() == 4
    assert q.series(m, m.first()["device_id"]).count() == 3


@pytest.mark.parametrize("mode,expected", [("event_time", 20.0), ("arrival", 5.0)])
def test_late_bad_poisons_successor_only_in_arrival_mode(spark, mode, expected):
    m = derive_measurements(fx.series_rows(spark, [(1, 10, "kWh"), (3, 30, "kWh"), (2, 25, "kals")]), mode)
    got = dict((r[0].minute, r[1]) for r in m.select("ts", "delta").collect())
    assert got[3] == expected


@pytest.mark.parametrize("mode,expected", [("event_time", 10.0), ("arrival", 6.0)])
def test_duplicate_with_other_value(spark, mode, expected):
    m = derive_measurements(fx.series_rows(spark, [(1, 10, "kWh"), (1, 14, "kWh"), (2, 20, "kWh")]), mode)
    assert m.where(F.minute("ts") == 2).first()["delta"] == expected


@pytest.mark.parametrize("mode", MODES)
def test_good_after_bad_at_same_ts_is_duplicate(spark, mode):
    m = derive_measurements(fx.series_rows(spark, [(1, 10, "kals"), (1, 10, "kWh")]), mode)
    assert rows(m, "is_bad", "is_duplicate", "delta") == [(True, False, None), (False, True, None)]


SAMPLE_TABLE = {
    # rows, good originals, normalised, reset, duplicate, late, bad, total delta
    "pump": (10, 9, 0, 1, 1, 1, 0, 30.0),
    "press": (4, 4, 4, 1, 0, 0, 0, 5.0),
    "crane": (4, 3, 0, 0, 0, 0, 1, 11.0),
    "gate": (3, 3, 0, 0, 0, 0, 0, 2.0),
    "oven": (4, 4, 0, 0, 0, 1, 0, 90.0),
    "belt": (3, 2, 0, 0, 0, 0, 1, 4.0),
}


@pytest.fixture(scope="module", params=MODES)
def sample(spark, request):
    return derive_measurements(fx.readings(spark, fx.SAMPLE), request.param)


def test_sample_per_device(sample):
    good = ~F.col("is_bad") & ~F.col("is_duplicate")
    got = {r[0]: tuple(r[1:]) for r in sample.groupBy("device_external_id").agg(
        F.count("*"), F.sum(good.cast("int")), F.sum(F.col("is_normal").cast("int")),
        F.sum(F.col("is_reset").cast("int")), F.sum(F.col("is_duplicate").cast("int")),
        F.sum(F.col("is_late").cast("int")), F.sum(F.col("is_bad").cast("int")),
        F.round(F.sum(F.when(good, F.col("delta"))), 6)).collect()}
    assert got == SAMPLE_TABLE


def test_sample_pump_deltas(sample):
    d = [r[0] for r in sample.where("device_external_id = 'pump' AND NOT is_duplicate")
         .orderBy("ts").select(F.round("delta", 6)).collect()]
    assert d == [None, 4.0, 5.0, 3.0, 3.0, 5.0, 6.0, 0.0, 4.0]  # 07:20 came late, 07:40 is repaired, 08:20 starts over


def test_sample_totals_and_buckets(sample):
    import uuid

    from wattline.functions.keys import KEY_NAMESPACE
    ids = {r[1]: r[0] for r in q.buildings(sample).collect()}
    assert [r[1] for r in q.buildings(sample).collect()] == ["Depot", "Mill", "Quay"]
    assert ids["Quay"] == str(uuid.uuid5(uuid.UUID(KEY_NAMESPACE), "building:quay"))
    tot = {n: round(q.sum_deltas(sample, i).first()[0], 6) for n, i in ids.items()}
    assert tot == {"Mill": 35.0, "Quay": 13.0, "Depot": 94.0}
    assert round(q.sum_deltas(sample).first()[0], 6) == 142.0
    b = {(r.label, r.ts.hour): (r.n, round(r.value, 4), round(r.delta, 4)) for r in
         q.aggregated(sample).join(sample.where("NOT is_bad AND NOT is_duplicate")
                                   .groupBy(F.col("building_name").alias("label"), F.date_trunc("hour", "ts").alias("ts"))
                                   .count().withColumnRenamed("count", "n"), ["label", "ts"]).collect()}
    assert b[("Mill", 6)] == (5, 3.3, 10.5)
    assert b[("Mill", 8)] == (3, 12.0, 10.0)
    assert b[("Quay", 7)] == (2, 9.0, 5.5)
    assert b[("Depot", 6)] == (2, 52.5, 0.0)
    assert b[("Depot", 9)] == (1, 190.0, 40.0)


def test_sample_bad_overlay(sample):
    got = [(r.label, r.ts.hour, r.value, r.delta) for r in q.bad_points(sample).collect()]
    assert got == [("Depot", 6, 900.0, 895.0), ("Quay", 8, 50.0, 36.0)]
    assert q.bad_points(sample, building="x").count() == 0


def test_unplaceable_readings_are_quarantined_not_lost(spark):
    import datetime as dt
    rows = [(0, 0, "B", "d", None, dt.datetime(2024, 3, 1, 8), "energy", 1.0, "kWh", None),
            (1, 1, "B", "d", None, None, "energy", 2.0, "kWh", None),
            (2, 2, "B", "d", None, dt.datetime(2024, 3, 1, 9), None, 3.0, "kWh", None)]
    r = spark.createDataFrame(rows, fx.SCHEMA)
    from wattline.operators.measure import invalid_readings
    assert derive_measurements(r).count() == 1
    bad = {x.reading_id: x.reason for x in invalid_readings(r).collect()}
    assert bad == {1: "timestamp", 2: "metric"}


def test_materialized_tables_can_be_dropped(spark):
    import os
    from wattline.session import drop_materialized, materialized_root
    m = derive_measurements(fx.series_rows(spark, [(0, 1, "kWh"), (5, 2, "kWh")]), "arrival")
    assert m.count() == 2
    root = materialized_root(spark)
    assert os.path.isdir(root.replace("file:", ""))
    assert drop_materialized(spark)
    assert not os.path.exists(root.replace("file:", ""))
