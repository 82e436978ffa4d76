import datetime as dt

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from wattline.operators.asof import asof_backward, asof_forward, existing, flag_existing
from wattline.operators.dims import resolve_dimension, resolve_ids
from wattline.operators.measure import derive_measurements
from wattline.operators.pivot import overlay_bad, pivot_labels
from wattline.operators.rolling import rolling, split_points
from wattline.plans import charts, queries as q


def t(m):
    return fx.T0 + dt.timedelta(minutes=m)


@pytest.fixture(scope="module")
def two_buildings(spark):
    b = [dict(building="B1", ext="d1", name=None, rows=[(t(0), "energy", 0.0, "kWh"), (t(10), "energy", 5.0, "kWh")]),
         dict(building="B2", ext="d2", name=None, rows=[(t(0), "energy", 0.0, "kWh"), (t(10), "energy", 3.0, "kWh")])]
    return derive_measurements(fx.readings(spark, b))


def test_per_building_buckets_1800s(two_buildings):
    got = sorted((r.label, r.value, r.delta) for r in q.aggregated(two_buildings, minutes=30).collect())
    assert got == [("B1", 2.5, 5.0), ("B2", 1.5, 3.0)]


def test_one_building_bucket_and_scope(spark):
    b = [dict(building="B1", ext="d1", name=None, rows=[(t(0), "energy", 0.0, "kWh"), (t(10), "energy", 5.0, "kWh")]),
         dict(building="B1", ext="d2", name=None, rows=[(t(0), "energy", 3.0, "kWh"), (t(10), "energy", 6.0, "kWh")])]
    m = derive_measurements(fx.readings(spark, b)).where("ts = '2024-03-01 08:10:00'")
    bid = m.first()["building_id"]
    r = q.aggregated(m, building=bid, minutes=30).collect()
    assert [(x.label, x.value, x.delta) for x in r] == [("Total", 5.5, 8.0)]
    assert q.aggregated(m, building=bid, device="d1", minutes=30).count() == 0


def test_device_and_building_totals(spark):
    b = [dict(building="B1", ext="d1", name=None, rows=[(t(i * 10), "energy", float(v), "kWh") for i, v in enumerate([0, 10, 20, 35])]),
         dict(building="B2", ext="d2", name=None, rows=[(t(i * 10), "energy", float(v), "kWh") for i, v in enumerate([0, 5, 15])])]
    m = derive_measurements(fx.readings(spark, b))
    d1 = m.where("device_external_id = 'd1'").first()
    assert q.sum_deltas(m, d1.building_id, d1.device_id).first()[0] == 35.0
    assert q.sum_deltas(m, "some-other-building", d1.device_id).first()[0] == 35.0  # building ignored
    assert q.sum_deltas(m, d1.building_id).first()[0] == 35.0
    assert q.sum_deltas(m).first()[0] == 50.0
    assert q.sum_deltas(m.where(F.lit(False))).first()[0] == 0.0


def test_bad_overlay_legacy_metric(spark):
    rows = [(0, 1, "B1", "d1", None, t(0), "energy_kwh_total", 5.0, "kWh", False, False, False, False, False, 0, None, None, None),
            (1, 2, "B2", "d2", None, t(0), "energy", 999.0, "kals", False, False, False, False, True, 1, None, None, None)]
    m = spark.createDataFrame(rows, "arrival_seq long, reading_id long, building_id string, device_id string, device_name string, ts timestamp, metric string, value double, unit string, is_normal boolean, is_reset boolean, is_duplicate boolean, is_late boolean, is_bad boolean, raw_event_id long, delta double, created_at timestamp, updated_at timestamp").withColumn("building_name", F.col("building_id")).withColumn("device_external_id", F.col("device_id"))
    got = [(r.label, r.value) for r in q.bad_points(m).collect()]
    assert got == [("B2", 999.0)]


def test_recent_keeps_duplicates_and_pages(spark):
    m = derive_measurements(fx.series_rows(spark, [(0, 1, "kWh"), (5, 2, "kWh"), (5, 2, "kWh"), (10, 3, "kals")]))
    dev = m.first()["device_id"]
    r = q.recent(m, dev, limit=2).collect()
    assert [(x.ts.minute, x.is_duplicate) for x in r] == [(5, False), (5, True)]
    assert q.recent(m, dev, limit=20).count() == 3
    assert q.recent(m, dev, limit=20, exclude_bad="false").count() == 4
    assert [x.ts.minute for x in q.recent(m, dev, limit=2, offset=1).collect()] == [5, 0]
    p = q.paged(q.recent(m, dev, limit=100, exclude_bad="no"), size=3).collect()
    assert [x.page for x in p] == [0, 0, 0, 1] and {x.pages for x in p} == {2}
    with pytest.raises(ValueError):
        q.recent(m, dev, limit=101)


def test_max_ts_latest_and_lists(spark):
    m = derive_measurements(fx.series_rows(spark, [(0, 1, "kWh"), (10, 2, "kWh"), (20, 3, "kWh"), (30, 9, "kals")]))
    assert q.max_ts(m).first()["max_ts"] == t(20)
    assert q.latest_per_series(m).first()["ts"] == t(30)
    assert q.devices(m, m.first()["building_id"]).count() == 1
    assert q.devices(m, "unknown").count() == 0


def test_rolling_avg_and_sum_frames(spark):
    df = spark.createDataFrame(
        [("a", t(0), 1.0, None, 0), ("a", t(20), 3.0, 2.0, 1), ("a", t(30), None, 1.0, 2), ("a", t(61), 5.0, 4.0, 3),
         ("b", t(0), 10.0, 1.0, 4)], "label string, ts timestamp, value double, delta double, id long")
    avg = {(r.label, r.id): r.value for r in rolling(df, "rolling_avg", 30, order=["id"]).collect()}
    assert avg == {("a", 0): 1.0, ("a", 1): 2.0, ("a", 2): 2.0, ("a", 3): 5.0, ("b", 4): 10.0}
    sm = {(r.label, r.id): r.value for r in rolling(df, "rolling_sum", 30, order=["id"]).collect()}
    assert sm == {("a", 0): 0.0, ("a", 1): 2.0, ("a", 2): 3.0, ("a", 3): 4.0, ("b", 4): 1.0}
    # width is inclusive at both ends: 08:00 -> 08:30 is inside a 30 minute window
    assert {r.id: r.value for r in rolling(df, "rolling_sum", 30, order=["id"]).where("label='a'").collect()}[2] == 3.0


def test_rolling_peers_are_taken_one_by_one(spark):
    df = spark.createDataFrame([("a", t(0), 1.0, 1), ("a", t(0), 3.0, 2), ("a", t(5), 5.0, 3)],
                               "label string, ts timestamp, value double, id long")
    got = {r.id: r.value for r in rolling(df, "rolling_avg", 30, order=["id"]).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0}


def test_rolling_across_slices_uses_halo(spark):
    df = spark.createDataFrame([("a", t(0), 1.0, 1), ("a", t(50), 3.0, 2), ("a", t(70), 5.0, 3)],
                               "label string, ts timestamp, value double, id long")
    got = {r.id: r.value for r in rolling(df, "rolling_avg", 30, order=["id"], slice_micros=60 * 60 * 10**6).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 4.0}


def test_split_points(spark):
    df = spark.createDataFrame([(1.0, 0.5, False, True), (2.0, None, True, False)], "value double, delta double, is_bad boolean, is_late boolean")
    r = [tuple(x) for x in split_points(df, "delta").select("mainValue", "badValue", "lateValue").collect()]
    assert r == [(0.5, None, 0.5), (None, None, None)]


def test_pivot_last_wins_and_overlay(spark):
    good = spark.createDataFrame([(t(0), "A", 1.0, 1), (t(0), "A", 2.0, 2), (t(0), "B", 5.0, 3), (t(60), "B", 6.0, 4)],
                                 "ts timestamp, label string, value double, k long")
    wide = pivot_labels(good, ["B", "A"], order=["k"])
    assert [tuple(r) for r in wide.collect()] == [(t(0), 2.0, 5.0), (t(60), None, 6.0)]
    bad = spark.createDataFrame([(t(0), "A", None, 1), (t(0), "Z", 9.0, 2), (t(30), "A", 7.0, 3)],
                                "ts timestamp, label string, value double, k long")
    out = overlay_bad(wide, bad, ["A", "B"], order=["k"])
    assert out.columns == ["ts", "A", "B", "bad_A", "bad_B"]
    assert [tuple(r) for r in out.collect()] == [(t(0), 2.0, 5.0, 0.0, None), (t(60), None, 6.0, None, None)]


def test_labels_with_dots_and_backticks(spark):
    rows = spark.createDataFrame([(t(0), "Bldg. 3", 1.0, 1), (t(0), "a`b", 2.0, 2)], "ts timestamp, label string, value double, k long")
    wide = pivot_labels(rows, ["Bldg. 3", "a`b"], order=["k"])
    out = overlay_bad(wide, rows, ["Bldg. 3", "a`b"], order=["k"])
    assert [tuple(r) for r in out.collect()] == [(t(0), 1.0, 2.0, 1.0, 2.0)]


def test_bad_points_bounds(spark):
    m = derive_measurements(fx.readings(spark, fx.SAMPLE))
    for minutes in (0, -5, 1441, 100000):
        with pytest.raises(ValueError):
            q.bad_points(m, minutes=minutes)


def test_charts(spark):
    m = derive_measurements(fx.readings(spark, fx.SAMPLE))
    h3 = charts.all_buildings_chart(m, show_bad=True, labels=["Mill", "Quay", "Depot"])
    assert h3.columns[:4] == ["ts", "Depot", "Mill", "Quay"]
    r = {x.ts.hour: x for x in h3.collect()}
    assert r[8]["bad_Quay"] == 50.0 and r[6]["bad_Depot"] == 900.0
    bid = [x.id for x in q.buildings(m).collect() if x.name == "Mill"][0]
    h2 = charts.building_chart(m, bid, mode="delta", labels=["press", "pump"])
    assert set(h2.columns) >= {"press", "pump", "bad_press"}
    long = charts.building_chart(m, bid, mode="delta")
    assert {x.label for x in long.collect()} == {"press", "pump"}
    assert charts.all_buildings_chart(m, show_bad=True).columns == ["ts", "label", "value", "tsLabel", "bad_value"]
    dev = m.where("device_external_id = 'crane'").first()["device_id"]
    h1 = charts.device_chart(m, dev, mode="raw", show_bad=True).collect()
    assert sum(x.badValue is not None for x in h1) == 1 and len(h1) == 4
    assert len(charts.device_chart(m, dev).collect()) == 3
    h4 = charts.series_per_building(m, mode="delta").collect()
    assert {x.building for x in h4} == {"Mill", "Quay", "Depot"}


def test_asof_lookups(spark):
    m = derive_measurements(fx.series_rows(spark, [(0, 0, "kWh"), (10, 10, "kWh"), (20, 25, "kWh")]))
    dev, met = m.first()["device_id"], m.first()["metric"]
    probes = spark.createDataFrame([(dev, met, t(15), "p1"), (dev, met, t(-5), "p2"), (dev, met, t(25), "p3")],
                                   "device_id string, metric string, ts timestamp, probe string")
    back = {r.probe: r.match_value for r in asof_backward(probes, m).collect()}
    fwd = {r.probe: r.match_value for r in asof_forward(probes, m).collect()}
    assert back == {"p1": 10.0, "p2": None, "p3": 25.0}
    assert fwd == {"p1": 25.0, "p2": 0.0, "p3": None}
    assert existing(probes, m).count() == 0
    assert flag_existing(m.select("device_id", "metric", "ts"), m).where("exists_in_log").count() == 3


def test_resolve_dimension(spark):
    known = spark.createDataFrame([("id-1", "North Campus")], "id string, name string")
    inc = spark.createDataFrame([(" north campus",), ("West",), ("WEST ",)], "name string")
    out = {(r.name, r.is_new): r.id for r in resolve_dimension(known, inc).collect()}
    assert out[("North Campus", False)] == "id-1"
    assert len(out) == 2 and ("WEST ", True) in out or ("West", True) in out
    ids = {r.name: r.id for r in resolve_ids(known, inc).collect()}
    assert ids[" north campus"] == "id-1" and ids["West"] == ids["WEST "]
