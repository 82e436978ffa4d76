"""

Every query reads the driver's tables (readings are derived from ``events``,
FIXTURES.md §3) over the whole table; results are rendered the way the
service answers (ISO-UTC timestamps, doubles rounded to 6 places) so Spark and
the SQL oracle compare value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.display import display, quality_label
from wattline.functions.filters import aggregate_filter
from wattline.functions.keys import KEY_NAMESPACE, dedupe_key
from wattline.functions.text import (ENERGY_METRIC, canonical_metric, canonical_unit, canonical_value, is_bad_flag,
                                     is_normal_flag, payload_json)
from wattline.functions.time import calendar_range, date_time_label, iso_utc, time_label
from wattline.operators.asof import arrived_before, asof_backward, asof_forward
from wattline.operators.dims import load_dimension, resolve_dimension, upsert_dimension
from wattline.operators.measure import derive_measurements, normalize, placeable
from wattline.operators.pivot import overlay_bad, pivot_labels
from wattline.operators.rolling import rolling
from wattline.plans import charts, queries as q, rollup
from wattline.plans.oracle import ENERGY as SQL_ENERGY, bucket as sql_bucket, iso as sql_iso, uuid5_sql, with_m
from wattline.session import ensure_checkpoint_dir, materialize
from wattline.sources.batches import (append_log, load_log, load_measurements, read_batches, read_bodies, rejected_bodies,
                                      write_batches, write_measurements)
from wattline.sources.tables import readings_from_events, table
from wattline.streaming.generations import refresh_slices
from wattline.streaming.ingest import events_as_batches, ingest_stream
from wattline.streaming.late_flag import FLAGS as LATE_FLAGS, late_flag_stream

SMOKE_DIR = "/root/testdata/sf0.001"

# Query parameters: one building and one device that exist at every scale.
_NS = uuid.UUID(KEY_NAMESPACE)
BUILDING_NAME = "Building 1"
DEVICE_EXT = "meter-7"
BUILDING = str(uuid.uuid5(_NS, "building:" + BUILDING_NAME.lower()))
DEVICE = str(uuid.uuid5(_NS, "device:" + DEVICE_EXT.lower()))
LABELS = [f"Building {i}" for i in range(5)]
ROLL_MIN = 180
METRICS = ["energy", " Energy_Total ", "ENERGY_KWH_TOTAL", "Temperature "]
UNITS = ["kWh", " WH", "wh", "MJ", " C "]
FLAGS = ["is_normal", "is_reset", "is_duplicate", "is_late", "is_bad"]


def _r(c) -> F.Column:
    """Render a double at 6 places; the 1e-9 nudge away from zero keeps exact
    ties (averages of 2, 4, 8 readings) from flipping with summation order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.signum(c) * F.lit(1e-9), 6)


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised readings with keys, for reads that need no flag of the history."""
    n = normalize(readings_from_events(spark, sf))
    return n.where(placeable(n))


def _m(spark: SparkSession, sf: str, mode: str = "event_time") -> DataFrame:
    return derive_measurements(readings_from_events(spark, sf), mode)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: measurements derived from sf0.001 events, then bucketed per
    building (A1)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _a1(spark, SMOKE_DIR)


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def _w12(spark, sf):
    m = _m(spark, sf)
    return m.select("arrival_seq", "reading_id", "building_id", "building_name", "device_id",
                    "device_external_id", "device_name", iso_utc("ts").alias("ts"), "metric",
                    _r("value").alias("value"), "unit", *FLAGS, "raw_event_id", _r("delta").alias("delta"),
                    iso_utc("created_at").alias("created_at"), iso_utc("updated_at").alias("updated_at"))


def _w7(spark, sf):
    m = _m(spark, sf, "arrival")
    return m.select("reading_id", "is_duplicate", "is_late", "is_reset", _r("delta").alias("delta"))


def _normalize(spark, sf):
    r = readings_from_events(spark, sf)
    r = r.withColumn("dedupe", dedupe_key("dedupe_key", "device_external_id", "metric", iso_utc("ts"),
                                          F.format_string("%.6f", F.col("value"))))
    n = normalize(r)
    return n.select("reading_id", "building_id", "device_id", "metric", "unit", _r("value").alias("value"),
                    "is_normal", "is_bad", "dedupe")


def _display(spark, sf):
    m = _m(spark, sf)
    return m.select("reading_id", quality_label().alias("quality"), time_label("ts").alias("time_label"),
                    date_time_label("ts").alias("date_time"))


def _agg_out(df):
    return df.select(iso_utc("ts").alias("ts"), "label", _r("value").alias("value"), _r("delta").alias("delta"))


def _a1(spark, sf):
    return _agg_out(q.aggregated(_m(spark, sf)))


def _a2(spark, sf):
    return _agg_out(q.aggregated(_m(spark, sf), building=BUILDING))


def _a3(spark, sf):
    return _agg_out(q.bad_points(_m(spark, sf)))


def _total(building, device):
    def run(spark, sf):
        return q.sum_deltas(_m(spark, sf), building, device).select(_r("sum_delta").alias("sum_delta"))
    return run


def _a8(spark, sf):
    return q.max_ts(_m(spark, sf)).select("device_id", "metric", iso_utc("max_ts").alias("max_ts"))


def _a9(spark, sf):
    return q.buildings(_placed(spark, sf))


def _a10(spark, sf):
    return q.devices(_placed(spark, sf), BUILDING)


def _wide_out(df, labels, bad=False):
    cols = [_r(F.col(f"`{lab}`")).alias(lab) for lab in labels]
    if bad:
        cols += [_r(F.col(f"`bad_{lab}`")).alias(f"bad_{lab}") for lab in labels]
    return df.select(iso_utc("ts").alias("ts"), *cols)


def _a11(spark, sf):
    agg = q.aggregated(_m(spark, sf))
    return _wide_out(pivot_labels(agg, LABELS, "value", order=["building_id"]), LABELS)


def _row_out(df):
    return df.select("id", iso_utc("ts").alias("ts"), "metric", _r("value").alias("value"), "unit",
                     _r("delta").alias("delta"), *FLAGS)


def _o1(spark, sf):
    r = q.recent(_m(spark, sf), DEVICE, limit=20, offset=0, exclude_bad="false")
    return _row_out(r)


def _o2(spark, sf):
    return _row_out(q.series(_m(spark, sf), DEVICE))


def _o3(spark, sf):
    s = q.building_series(_m(spark, sf), BUILDING)
    return s.select(iso_utc("ts").alias("ts"), "metric", _r("value").alias("value"), "unit",
                    _r("delta").alias("delta"), *FLAGS, "device_id", "label")


def _o4(spark, sf):
    a = q.all_measurements(_m(spark, sf))
    return a.select("id", "building_id", "device_id", iso_utc("ts").alias("ts"), _r("value").alias("value"),
                    _r("delta").alias("delta"), *FLAGS)


def _o5(spark, sf):
    r = q.recent(_m(spark, sf), DEVICE, limit=100, exclude_bad="false")
    return q.paged(r).select("id", "page", "pages")


def _o6(spark, sf):
    lt = q.latest_per_series(_m(spark, sf))
    return lt.select("device_id", "metric", iso_utc("ts").alias("ts"), "arrival_seq", "reading_id",
                     _r("value").alias("value"))


def _roll(mode):
    def run(spark, sf):
        s = q.building_series(_m(spark, sf), BUILDING)
        out = rolling(s, mode, ROLL_MIN, by=["label"], order=["device_id", "arrival_seq", "id"])
        return out.select("id", "label", iso_utc("ts").alias("ts"), _r("value").alias("value"))
    return run


def _h1(spark, sf):
    c = charts.device_chart(_m(spark, sf), DEVICE, mode="rolling_sum", rolling_minutes=ROLL_MIN, show_bad=True)
    return c.select("id", iso_utc("ts").alias("ts"), "tsLabel", _r("value").alias("value"),
                    _r("delta").alias("delta"), _r("mainValue").alias("mainValue"),
                    _r("badValue").alias("badValue"), _r("lateValue").alias("lateValue"))


def _h2(spark, sf):
    c = charts.building_chart(_m(spark, sf), BUILDING, mode="delta", show_bad=False)
    return c.select(iso_utc("ts").alias("ts"), "label", _r("value").alias("value"))


def _h3(spark, sf):
    c = charts.all_buildings_chart(_m(spark, sf), rolling_minutes=ROLL_MIN, show_bad=True, labels=LABELS)
    return _wide_out(c, LABELS, bad=True).withColumn("tsLabel", F.substring("ts", 12, 8))


# a viewer's calendar range (UTC), inclusive at both ends.
RANGE_START, RANGE_END = calendar_range("2024-01-10", "2024-01-20", "06:00", "18:00")


def _f6(spark, sf):
    return _row_out(q.series(_m(spark, sf), DEVICE, start=RANGE_START, end=RANGE_END))


def _a1_range(spark, sf):
    return _agg_out(q.aggregated(_m(spark, sf), start=RANGE_START, end=RANGE_END, minutes=30))


def _a4_range(spark, sf):
    return q.sum_deltas(_m(spark, sf), start=RANGE_START, end=RANGE_END).select(_r("sum_delta").alias("sum_delta"))


def _o1_offset(spark, sf):
    return _row_out(q.recent(_m(spark, sf), DEVICE, limit=10, offset=20))


def _h1_avg(spark, sf):
    c = charts.device_chart(_m(spark, sf), DEVICE, mode="rolling_avg", rolling_minutes=120, show_bad=False,
                            start=RANGE_START, end=RANGE_END)
    return c.select("id", iso_utc("ts").alias("ts"), _r("value").alias("value"),
                    _r("mainValue").alias("mainValue"), _r("lateValue").alias("lateValue"))


def _h4_raw(spark, sf):
    s = charts.series_per_building(_m(spark, sf), mode="raw")
    return s.select("building", iso_utc("ts").alias("ts"), _r("value").alias("value"))


def _h4(spark, sf):
    s = charts.series_per_building(_m(spark, sf), mode="delta")
    return s.select("building", iso_utc("ts").alias("ts"), "tsLabel", _r("delta").alias("delta"))


def _j1(spark, sf):
    """Every reading against everything that arrived before it, of any quality."""
    n = _placed(spark, sf)
    return arrived_before(n, n).select("reading_id")


def _asof(fn, log):
    def run(spark, sf):
        probes = normalize(readings_from_events(spark, sf)).select("reading_id", "device_id", "metric", "ts")
        return fn(probes, log(spark, sf)).select("reading_id", "match_id", _r("match_value").alias("match_value"))
    return run


def _with_legacy(m: DataFrame) -> DataFrame:
    """Measurements in which every third bad reading still has the metric name of old rows."""
    old = F.col("is_bad") & (F.col("reading_id") % 3 == 0)
    return m.withColumn("metric", F.when(old, F.lit("energy")).otherwise(F.col("metric")))


def _f4(spark, sf):
    return _row_out(q.series(_with_legacy(_m(spark, sf)), DEVICE, exclude_bad=False))


def _f5(spark, sf):
    return _agg_out(q.bad_points(_with_legacy(_m(spark, sf)), minutes=1440))


def _f5b(spark, sf):
    m = _with_legacy(_m(spark, sf))
    return m.where(aggregate_filter(ENERGY_METRIC, exclude_bad=False, legacy_bad=True)).select("reading_id", "metric", "is_bad")


def _a7(spark, sf):
    """Rows that every scope gives; a device total ignores the building."""
    m = _m(spark, sf)
    scopes = {"aggregate all": q.aggregated(m), "aggregate building": q.aggregated(m, BUILDING),
              "aggregate device": q.aggregated(m, BUILDING, DEVICE), "bad all": q.bad_points(m),
              "bad building": q.bad_points(m, BUILDING)}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("scope"), F.col("n").cast("double").alias("result"))
              for k, df in scopes.items()]
    totals = [q.sum_deltas(m, b, d).select(F.lit(f"total {k}").alias("scope"), _r("sum_delta").alias("result"))
              for k, (b, d) in {"all wins": (q.ALL, DEVICE), "device": ("no building", DEVICE)}.items()]
    return reduce(DataFrame.unionByName, counts + totals)


def _c15(spark, sf):
    m = _m(spark, sf)
    return m.select("reading_id", display("value").alias("value"), display("delta").alias("delta"))


def _c16(spark, sf):
    ev = table(spark, sf, "events")
    payload = F.when(F.col("event_type") != "error", F.struct("event_id", "event_type"))
    r = ev.select("event_id", payload.alias("payload"), "props")
    return r.select("event_id", payload_json(F.col("payload"), r.schema["payload"].dataType).alias("payload"),
                    payload_json(F.col("props"), r.schema["props"].dataType).alias("props"))


def _c2(spark, sf):
    """Every event with a metric and unit spelling by its number: aliases, padding, other metrics."""
    ev = table(spark, sf, "events")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    r = ev.select("event_id", "value", pick(METRICS, F.col("event_id")).alias("metric"),
                  pick(UNITS, F.floor(F.col("event_id") / len(METRICS))).alias("unit"),
                  F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("k"), "event_id")).otherwise("").alias("given"))
    return r.select("event_id", canonical_metric("metric").alias("metric"), canonical_unit("metric", "unit").alias("unit"),
                    _r(canonical_value("metric", "unit", "value")).alias("value"),
                    is_normal_flag("metric", "unit").alias("is_normal"), is_bad_flag("metric", "unit").alias("is_bad"),
                    dedupe_key("given", "event_id", "metric", "unit", F.lit("x")).alias("dedupe"))


def _p3(spark, sf):
    """Labels of devices without external id or name, at every reading."""
    m = _m(spark, sf)
    ext = F.when(F.col("reading_id") % 3 == 0, F.col("device_external_id"))
    name = F.when(F.col("reading_id") % 3 == 1, F.concat(F.lit("name "), "device_external_id"))
    return (m.withColumn("device_name", name).withColumn("device_external_id", ext)
            .select("reading_id", q.label_expr().alias("label")))


def _j5_devices(spark, sf):
    known = _placed(spark, sf).select(F.col("device_id").alias("id"), F.col("device_external_id").alias("external_id"),
                                      F.col("device_name").alias("name")).distinct()
    incoming = table(spark, sf, "customer").select(F.concat(F.lit(" METER-"), "c_custkey").alias("external_id"),
                                                   F.col("c_name").alias("name"))
    return resolve_dimension(known, incoming, "device").select("id", "external_id", "name", "is_new")


def _j4(spark, sf):
    m = _m(spark, sf)
    wide = pivot_labels(q.aggregated(m), LABELS, "value", order=["building_id"])
    out = overlay_bad(wide, q.bad_points(m), LABELS, "value", order=["building_id", "label"])
    return _wide_out(out, LABELS, bad=True)


def _j5(spark, sf):
    known = q.buildings(_placed(spark, sf))
    incoming = (readings_from_events(spark, sf).select(F.upper("building_name").alias("name"))
                .unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("name"))))
    return resolve_dimension(known, incoming, "building").select("id", "name", "is_new")


def _scratch(spark, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wattline-{kind}/{uuid.uuid4().hex}"


def _batches(spark, sf) -> DataFrame:
    """Readings of the whole ``events`` table as request bodies, several per device and file."""
    return events_as_batches(readings_from_events(spark, sf))


FILE_BLOCKS = 32


def _deliver(batches, path, mode="overwrite"):
    """Write bodies as files of many arrival blocks, in the order of blocks: the number of files to
    list, read and commit stays small beside the readings."""
    write_batches(batches.withColumn("file", F.floor(F.col("block") / FILE_BLOCKS)), path, "file",
                  ("block", "device.external_id", "part"), mode)


def _reading_rows(m):
    return m.select("reading_id", "arrival_seq", "raw_event_id", "device_external_id", iso_utc("ts").alias("ts"),
                    _r("value").alias("value"), *FLAGS, _r("delta").alias("delta"))


def _s1(spark, sf):
    path = _scratch(spark, "batches")
    _deliver(_batches(spark, sf), path)
    return _reading_rows(derive_measurements(read_batches(spark, path)))


def _s1_quarantine(spark, sf):
    """Every error event as a broken body (cut off, or without readings) between good ones."""
    path = _scratch(spark, "rejects")
    ev = table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    cut = F.concat(F.lit('{"device": {"external_id": "meter-'), user)
    whole = F.concat(cut, F.lit('"}'))
    reading = F.lit(', "readings": [{"timestamp": "2024-01-01T00:00:00Z", "metric": "energy", "value": 1.5, "unit": "kWh"}]}')
    body = (F.when(F.col("event_type") != "error", F.concat(whole, reading))
            .when(F.col("event_id") % 2 == 0, cut).otherwise(F.concat(whole, F.lit("}"))))
    ev.select(body.alias("value")).write.text(path)
    return rejected_bodies(read_bodies(spark, path)).select("body", "reason")


TRIGGERS = 5
# Parts of the stored table at the sizes of the driver's tables: four buckets, slices of five days.
STORED = {"buckets": 4, "hours": 120}


def _ingested(spark, sf, measure=True):
    """The batches of ``events`` delivered in five parts, one trigger each."""
    src, root = _scratch(spark, "inbox"), _scratch(spark, "stream")
    batches = materialize(_batches(spark, sf), "batches")
    last = batches.agg(F.max("block")).first()[0]
    for k in range(TRIGGERS):
        _deliver(batches.where(F.floor(F.col("block") * TRIGGERS / (last + 1)) == k), src, "append")
        ingest_stream(spark, src, f"{root}/log", f"{root}/checkpoint", raw_path=f"{root}/raw",
                      out_path=f"{root}/measurements" if measure else None, max_files=last + 1, **STORED).awaitTermination()
    return root


def _kept(spark, sf, triggers=2, mode="event_time", again=()):
    """Path of a stored table that took the readings in several refreshes, late ones across them."""
    path = _scratch(spark, "kept")
    r = readings_from_events(spark, sf)
    last = r.agg(F.max("arrival_seq")).first()[0]
    for k in sorted([*range(triggers), *again]):
        refresh_slices(spark, r.where(F.floor(F.col("arrival_seq") * triggers / (last + 1)) == k), path, k, mode, **STORED)
    return path


def _r2(spark, sf):
    """The readings in five refreshes with late repairs between them, the third one twice; deltas of the arrival order."""
    m = load_measurements(spark, _kept(spark, sf, TRIGGERS, "arrival", again=(2,)))
    return m.select("reading_id", "is_duplicate", "is_late", "is_reset", _r("delta").alias("delta"))


def _r1(spark, sf):
    return _reading_rows(load_measurements(spark, f"{_ingested(spark, sf)}/measurements"))


def _rollup(spark, sf):
    """Aggregates and totals from the rollup of the stored table, after late repairs."""
    path = _kept(spark, sf)
    wide = {"all": rollup.aggregated(spark, path), "building": rollup.aggregated(spark, path, BUILDING),
            "range": rollup.aggregated(spark, path, start=RANGE_START, end=RANGE_END, minutes=30), "bad": rollup.bad_points(spark, path)}
    totals = {"total": {}, "total building": {"building": BUILDING}, "total device": {"building": BUILDING, "device": DEVICE},
              "total range": {"start": RANGE_START, "end": RANGE_END}}
    rows = [_agg_out(df).withColumn("kind", F.lit(k)) for k, df in wide.items()]
    none = F.lit(None)
    rows += [rollup.sum_deltas(spark, path, **args).select(
        none.cast("string").alias("ts"), none.cast("string").alias("label"), none.cast("double").alias("value"), _r("sum_delta").alias("delta"),
        F.lit(k).alias("kind")) for k, args in totals.items()]
    return reduce(DataFrame.unionByName, rows)


def _o1_stored(spark, sf):
    """The newest page of a device from the stored table, newest slices first."""
    return _row_out(rollup.recent(spark, _kept(spark, sf), DEVICE, limit=20, offset=0, exclude_bad="false"))


def _j5_stream(spark, sf):
    """Devices kept over five triggers that spell them differently; the third and the last come twice."""
    path = _scratch(spark, "devices")
    r = readings_from_events(spark, sf)
    last = r.agg(F.max("arrival_seq")).first()[0]
    spelled = r.select(F.floor(F.col("arrival_seq") * TRIGGERS / (last + 1)).alias("k"), F.when(
        F.col("reading_id") % 2 == 0, F.concat(F.lit(" "), F.upper("device_external_id"))).otherwise(F.col("device_external_id")).alias("external_id"))
    for k in (0, 1, 2, 2, 3, 4, 4):
        upsert_dimension(spark, spelled.where(F.col("k") == k).drop("k"), path, k, "device")
    return load_dimension(spark, path, "device")


def _r4(spark, sf):
    """Late flags from per-series state; the log grows in five triggers and the stream follows it."""
    root = _scratch(spark, "late")
    r = readings_from_events(spark, sf)
    last = r.agg(F.max("arrival_seq")).first()[0]
    for k in range(TRIGGERS):
        part = r.where(F.floor(F.col("arrival_seq") * TRIGGERS / (last + 1)) == k)
        append_log(part.withColumn("batch_id", F.lit(k).cast("long")), f"{root}/log", STORED["buckets"], k)
        late_flag_stream(spark, f"{root}/log", f"{root}/flags", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(LATE_FLAGS).parquet(f"{root}/flags").select("device_id", "metric", "reading_id", "is_late")


def _s4(spark, sf):
    """One device and range of the stored table (bucket and months pruned)."""
    path = _scratch(spark, "measurements")
    write_measurements(_m(spark, sf), path)
    stored = load_measurements(spark, path, DEVICE, start=RANGE_START, end=RANGE_END)
    return _row_out(q.series(stored, DEVICE, start=RANGE_START, end=RANGE_END))


def _s2(spark, sf):
    """Raw rows of the stream with the logged reading each belongs to."""
    root = _ingested(spark, sf, measure=False)
    log = normalize(load_log(spark, f"{root}/log")).drop("batch_id")
    return (spark.read.parquet(f"{root}/raw").select("id", "batch_id").join(log, F.col("id") == log["reading_id"])
            .select("id", "batch_id", "device_external_id", iso_utc("ts").alias("ts"), _r("value").alias("value")))


def _utc(fn):
    """Timestamps in the tables are ``timestamp_ntz`` read as UTC, and results
    render ISO-UTC: pin the session time zone before planning."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _training_data():
    """Queries and pipeline of the training-data operators; None where they are not installed."""
    try:
        import corpus_pipeline
        from wattline.llm import queries as llm
    except ModuleNotFoundError as e:
        if e.name in ("corpus_pipeline", "wattline.llm"):
            return None
        raise
    return llm, corpus_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = _training_data()
    more = {} if found is None else {**found[0].queries(), "pipeline": found[1].run}
    return {name: _utc(fn) for name, fn in {**_queries(), **more}.items()}


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "s1_read_batches": _s1,
        "s1_quarantine": _s1_quarantine,
        "s2_raw_events": _s2,
        "s4_device_range": _s4,
        "r1_ingest_stream": _r1,
        "r2_refresh": _r2,
        "r4_late_flag_stream": _r4,
        "w12_measurements": _w12,
        "w7_arrival_measurements": _w7,
        "c_normalize_keys": _normalize,
        "c_display_labels": _display,
        "a1_bucketed_all": _a1,
        "a2_bucketed_building": _a2,
        "a3_bad_overlay": _a3,
        "a4_total_all": _total(q.ALL, q.ALL),
        "a5_total_building": _total(BUILDING, q.ALL),
        "a6_total_device": _total(BUILDING, DEVICE),
        "a8_max_ts": _a8,
        "a9_buildings": _a9,
        "a10_devices": _a10,
        "a11_pivot": _a11,
        "o1_recent": _o1,
        "o2_device_series": _o2,
        "o3_building_series": _o3,
        "o4_all_measurements": _o4,
        "o5_pages": _o5,
        "o6_latest_per_series": _o6,
        "w8_rolling_avg": _roll("rolling_avg"),
        "w9_rolling_sum": _roll("rolling_sum"),
        "h1_device_chart": _h1,
        "h2_building_chart": _h2,
        "h3_all_buildings_chart": _h3,
        "h4_series_per_building": _h4,
        "j1_existing": _j1,
        "j2_asof_backward": _asof(asof_backward, _placed),
        "j3_asof_forward": _asof(asof_forward, _m),
        "j4_overlay": _j4,
        "j5_resolve_buildings": _j5,
        "f4_legacy_in_series": _f4,
        "f5_legacy_in_overlay": _f5,
        "f5b_legacy_in_aggregate": _f5b,
        "a7_scopes": _a7,
        "a_rollup": _rollup,
        "c2_spellings": _c2,
        "c15_display": _c15,
        "c16_payload_text": _c16,
        "p3_labels": _p3,
        "j5_resolve_devices": _j5_devices,
        "j5_devices_kept": _j5_stream,
        "o1_recent_stored": _o1_stored,
        "f6_device_series_range": _f6,
        "a1_bucketed_range_30min": _a1_range,
        "a4_total_range": _a4_range,
        "o1_recent_offset": _o1_offset,
        "h1_device_chart_rolling_avg": _h1_avg,
        "h4_series_per_building_raw": _h4_raw,
    }


# ---------------------------------------------------------------------------
# SQL oracle (DuckDB)
# ---------------------------------------------------------------------------

GOOD = "metric = 'energy_kwh_total' AND NOT is_bad AND NOT is_duplicate"
FLAG_SQL = ", ".join(FLAGS)


def _sql_agg(where: str, group_label: str, label_expr: str) -> str:
    b = sql_bucket("ts", 60)
    return (f"SELECT {sql_iso('b')} AS ts, {label_expr} AS label, round(avg(value), 6) AS value, "
            f"round(sum(coalesce(delta, 0)), 6) AS delta FROM (SELECT *, {b} AS b FROM m WHERE {where}) "
            f"GROUP BY b{group_label}")


def _sql_a1_raw() -> str:
    b = sql_bucket("ts", 60)
    return (f"a1 AS (SELECT b AS ts, building_id, building_name AS label, avg(value) AS value, "
            f"sum(coalesce(delta, 0)) AS delta FROM (SELECT *, {b} AS b FROM m WHERE {GOOD}) "
            f"GROUP BY b, building_id, building_name)")


def _sql_a3_raw() -> str:
    b = sql_bucket("ts", 60)
    return (f"a3 AS (SELECT b AS ts, building_id, building_name AS label, avg(value) AS value, "
            f"sum(coalesce(delta, 0)) AS delta FROM (SELECT *, {b} AS b FROM m "
            f"WHERE (metric = 'energy_kwh_total' OR (metric = 'energy' AND is_bad)) AND is_bad AND NOT is_duplicate) "
            f"GROUP BY b, building_id, building_name)")


def _sql_pivot(src: str, prefix: str = "", null_zero: bool = False) -> str:
    v = "coalesce(value, 0)" if null_zero else "value"
    return ", ".join(f"arg_max({v}, building_id) FILTER (WHERE label = '{lab}') AS \"{prefix}{lab}\""
                     for lab in LABELS)


def _sql_round_labels(prefix: str = "") -> str:
    return ", ".join(f"round(\"{prefix}{lab}\", 6) AS \"{prefix}{lab}\"" for lab in LABELS)


def _sql_rolling(src: str, base: str, part: str, minutes: int) -> str:
    w = minutes * 60 * 1_000_000
    return (f"{base} OVER (PARTITION BY {part} ORDER BY epoch_us(ts) "
            f"RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)")


def _guard_rounding(sql: str) -> str:
    """Rewrite every ``round(x, 6)`` as ``round(x + sign(x) * 1e-9, 6)``: the
    same tie guard the Spark side applies (see ``_r``)."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        if inner.endswith(", 6"):
            x = _guard_rounding(inner[:-3])
            out.append(sql[i:j] + f"round(({x}) + sign({x}) * 1e-9, 6)")
        else:
            out.append(sql[i:k])
        i = k


def oracle_sql() -> dict[str, str]:
    found = _training_data()
    more = {} if found is None else dict(found[0].oracle_sql())
    if found is not None and found[1].ORACLE_SQL:
        more["pipeline"] = found[1].ORACLE_SQL
    return {**{k: _guard_rounding(v) for k, v in _oracle_sql().items()}, **more}


def _oracle_sql() -> dict[str, str]:
    row_cols = (f"reading_id AS id, {sql_iso('ts')} AS ts, metric, round(value, 6) AS value, unit, "
                f"round(delta, 6) AS delta, {FLAG_SQL}")
    series_where = f"device_id = '{DEVICE}' AND metric = 'energy_kwh_total' AND NOT is_duplicate"
    bseries = f"building_id = '{BUILDING}' AND metric = 'energy_kwh_total' AND NOT is_bad AND NOT is_duplicate"
    recent_order = "ORDER BY ts DESC, arrival_seq, reading_id"
    rng = (f"ts >= TIMESTAMP '{RANGE_START:%Y-%m-%d %H:%M:%S.%f}' "
           f"AND ts <= TIMESTAMP '{RANGE_END:%Y-%m-%d %H:%M:%S.%f}'")
    label = "coalesce(device_external_id, device_name, device_id)"
    device_range = f"SELECT {row_cols} FROM m WHERE {series_where} AND NOT is_bad AND {rng}"
    legacy = ("lm AS (SELECT * REPLACE (CASE WHEN is_bad AND reading_id % 3 = 0 THEN 'energy' ELSE metric END AS metric) "
              "FROM m)")
    a1 = _sql_a1_raw()
    a3 = _sql_a3_raw()
    h3_roll = _sql_rolling("a1", "avg(value)", "label", ROLL_MIN)
    # Arrival numbers of the request bodies: block, device, then arrival in the body.
    numbered = ("(SELECT m.*, row_number() OVER (ORDER BY arrival_seq // 1000, device_external_id, arrival_seq, reading_id) - 1 "
                "AS num, arrival_seq // 1000 AS block FROM m)")
    reading_rows = (f"SELECT num AS reading_id, num AS arrival_seq, num AS raw_event_id, device_external_id, "
                    f"{sql_iso('ts')} AS ts, round(value, 6) AS value, {FLAG_SQL}, round(delta, 6) AS delta FROM {numbered}")
    cut = "'{\"device\": {\"external_id\": \"meter-' || user_id"
    no_list = "'{\"device\":{\"external_id\":\"meter-' || user_id || '\"}}'"
    return {
        "s1_read_batches": with_m(reading_rows),
        "s1_quarantine": (
            f"SELECT CASE WHEN event_id % 2 = 0 THEN {cut} ELSE {no_list} END AS body, "
            "CASE WHEN event_id % 2 = 0 THEN 'malformed' ELSE 'no readings' END AS reason "
            "FROM events WHERE event_type = 'error'"),
        "s2_raw_events": with_m(
            # A part without bodies starts no trigger.
            f"SELECT num AS id, dense_rank() OVER (ORDER BY block * {TRIGGERS} // ((SELECT max(arrival_seq) // 1000 FROM m) + 1)) "
            "- 1 AS batch_id, "
            f"device_external_id, {sql_iso('ts')} AS ts, round(value, 6) AS value FROM {numbered}"),
        "r1_ingest_stream": with_m(reading_rows),
        "r4_late_flag_stream": with_m("SELECT device_id, metric, reading_id, is_late FROM m"),
        "r2_refresh": with_m(
            "SELECT reading_id, is_duplicate, is_late, coalesce(d_raw = 0, false) AS is_reset, "
            "round(CASE WHEN NOT is_duplicate THEN d_raw END, 6) AS delta FROM am", arrival=True),
        "w12_measurements": with_m(
            f"SELECT arrival_seq, reading_id, building_id, building_name, device_id, device_external_id, "
            f"device_name, {sql_iso('ts')} AS ts, metric, round(value, 6) AS value, unit, {FLAG_SQL}, raw_event_id, "
            f"round(delta, 6) AS delta, {sql_iso('created_at')} AS created_at, "
            f"{sql_iso('updated_at')} AS updated_at FROM m"),
        "w7_arrival_measurements": with_m(
            "SELECT reading_id, is_duplicate, is_late, coalesce(d_raw = 0, false) AS is_reset, "
            "round(CASE WHEN NOT is_duplicate THEN d_raw END, 6) AS delta FROM am", arrival=True),
        "c_normalize_keys": with_m(
            "SELECT reading_id, building_id, device_id, metric, unit, round(value, 6) AS value, is_normal, is_bad, "
            f"sha256(concat_ws('|', device_external_id, raw_metric, {sql_iso('ts')}, printf('%.6f', raw_value))) "
            "AS dedupe FROM c"),
        "c_display_labels": with_m(
            "SELECT reading_id, concat_ws(', ', CASE WHEN is_normal THEN 'Normalized' END, "
            "CASE WHEN is_reset THEN 'Reset' END, CASE WHEN is_duplicate THEN 'Duplicate' END, "
            "CASE WHEN is_late THEN 'Late' END, CASE WHEN is_bad THEN 'Bad' END) AS quality, "
            "strftime(ts, '%H:%M:%S') AS time_label, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date_time FROM m"),
        "a1_bucketed_all": with_m(_sql_agg(GOOD, ", building_id, building_name", "building_name")),
        "a2_bucketed_building": with_m(_sql_agg(f"{GOOD} AND building_id = '{BUILDING}'", "", "'Total'")),
        "a3_bad_overlay": with_m(_sql_agg(
            "(metric = 'energy_kwh_total' OR (metric = 'energy' AND is_bad)) AND is_bad AND NOT is_duplicate",
            ", building_id, building_name", "building_name")),
        "a4_total_all": with_m(f"SELECT round(coalesce(sum(delta), 0), 6) AS sum_delta FROM m WHERE {GOOD}"),
        "a5_total_building": with_m(
            f"SELECT round(coalesce(sum(delta), 0), 6) AS sum_delta FROM m WHERE {GOOD} AND building_id = '{BUILDING}'"),
        "a6_total_device": with_m(
            f"SELECT round(coalesce(sum(delta), 0), 6) AS sum_delta FROM m WHERE {GOOD} AND device_id = '{DEVICE}'"),
        "a8_max_ts": with_m(
            f"SELECT device_id, metric, {sql_iso('max(CASE WHEN NOT is_bad AND NOT is_duplicate THEN ts END)')} "
            "AS max_ts FROM m GROUP BY device_id, metric"),
        "a9_buildings": with_m("SELECT DISTINCT building_id AS id, building_name AS name FROM m"),
        "a10_devices": with_m(
            "SELECT DISTINCT device_id AS id, building_id, device_external_id AS external_id, device_name AS name "
            f"FROM m WHERE building_id = '{BUILDING}'"),
        "a11_pivot": with_m(
            f", {a1} SELECT {sql_iso('ts')} AS ts, {_sql_round_labels()} FROM "
            f"(SELECT ts, {_sql_pivot('a1')} FROM a1 GROUP BY ts)"),
        "o1_recent_stored": with_m(
            f"SELECT {row_cols} FROM m WHERE device_id = '{DEVICE}' AND (metric = 'energy_kwh_total' "
            f"OR (metric = 'energy' AND is_bad)) {recent_order} LIMIT 20"),
        "j5_devices_kept": with_m(
            f", s AS (SELECT device_id AS id, arrival_seq * {TRIGGERS} // ((SELECT max(arrival_seq) FROM c) + 1) AS k, "
            "CASE WHEN reading_id % 2 = 0 THEN ' ' || upper(device_external_id) ELSE device_external_id END AS external_id FROM c) "
            "SELECT id, min(external_id) AS external_id, CAST(NULL AS VARCHAR) AS name FROM s "
            "WHERE k = (SELECT min(k) FROM s t WHERE t.id = s.id) GROUP BY id"),
        "o1_recent": with_m(
            f"SELECT {row_cols} FROM m WHERE device_id = '{DEVICE}' AND (metric = 'energy_kwh_total' "
            f"OR (metric = 'energy' AND is_bad)) {recent_order} LIMIT 20"),
        "o2_device_series": with_m(f"SELECT {row_cols} FROM m WHERE {series_where} AND NOT is_bad"),
        "o3_building_series": with_m(
            f"SELECT {sql_iso('ts')} AS ts, metric, round(value, 6) AS value, unit, round(delta, 6) AS delta, "
            f"{FLAG_SQL}, device_id, {label} AS label FROM m WHERE {bseries}"),
        "o4_all_measurements": with_m(
            f"SELECT reading_id AS id, building_id, device_id, {sql_iso('ts')} AS ts, round(value, 6) AS value, "
            f"round(delta, 6) AS delta, {FLAG_SQL} FROM m"),
        "o5_pages": with_m(
            "SELECT id, CAST(floor((rn - 1) / 5) AS BIGINT) AS page, "
            "CAST(greatest(1, ceil(count(*) OVER () / 5)) AS BIGINT) AS pages FROM ("
            f"SELECT reading_id AS id, row_number() OVER ({recent_order}) AS rn FROM m "
            f"WHERE device_id = '{DEVICE}' AND (metric = 'energy_kwh_total' OR (metric = 'energy' AND is_bad)) "
            f"{recent_order} LIMIT 100)"),
        "o6_latest_per_series": with_m(
            f"SELECT device_id, metric, {sql_iso('ts')} AS ts, arrival_seq, reading_id, round(value, 6) AS value "
            "FROM (SELECT *, row_number() OVER (PARTITION BY device_id, metric "
            "ORDER BY ts DESC, arrival_seq DESC, reading_id DESC) AS rn FROM m) WHERE rn = 1"),
        "w8_rolling_avg": with_m(
            f"SELECT reading_id AS id, {label} AS label, {sql_iso('ts')} AS ts, "
            f"round({_sql_rolling('m', 'avg(value)', label, ROLL_MIN)}, 6) AS value FROM m WHERE {bseries}"),
        "w9_rolling_sum": with_m(
            f"SELECT reading_id AS id, {label} AS label, {sql_iso('ts')} AS ts, "
            f"round({_sql_rolling('m', 'sum(coalesce(delta, 0))', label, ROLL_MIN)}, 6) AS value "
            f"FROM m WHERE {bseries}"),
        "h1_device_chart": with_m(
            f"SELECT id, {sql_iso('ts')} AS ts, strftime(ts, '%H:%M:%S') AS tsLabel, round(v, 6) AS value, "
            "round(delta, 6) AS delta, round(CASE WHEN NOT is_bad THEN v END, 6) AS mainValue, "
            "round(CASE WHEN is_bad THEN v END, 6) AS badValue, round(CASE WHEN is_late THEN v END, 6) AS lateValue "
            f"FROM (SELECT reading_id AS id, ts, delta, is_bad, is_late, "
            f"{_sql_rolling('m', 'sum(coalesce(delta, 0))', 'device_id', ROLL_MIN)} AS v FROM m "
            f"WHERE {series_where})"),
        "h3_all_buildings_chart": with_m(
            f", {a1}, {a3}, rl AS (SELECT ts, building_id, label, {h3_roll} AS value FROM a1), "
            f"w AS (SELECT ts, {_sql_pivot('rl')} FROM rl GROUP BY ts), "
            f"b AS (SELECT ts, {_sql_pivot('a3', 'bad_', True)} FROM a3 GROUP BY ts) "
            f"SELECT {sql_iso('w.ts')} AS ts, {_sql_round_labels()}, {_sql_round_labels('bad_')}, "
            "strftime(w.ts, '%H:%M:%S') AS tsLabel FROM w LEFT JOIN b ON w.ts = b.ts"),
        "h4_series_per_building": with_m(
            f", {a1} SELECT label AS building, {sql_iso('ts')} AS ts, strftime(ts, '%H:%M:%S') AS tsLabel, "
            "round(coalesce(delta, 0), 6) AS delta FROM a1"),
        "j1_existing": with_m(
            "SELECT reading_id FROM c WHERE EXISTS (SELECT 1 FROM c s WHERE s.device_id = c.device_id AND s.metric = c.metric "
            "AND s.ts = c.ts AND (s.arrival_seq < c.arrival_seq OR s.arrival_seq = c.arrival_seq AND s.reading_id < c.reading_id))"),
        "j2_asof_backward": with_m(
            "SELECT p.reading_id, h.reading_id AS match_id, round(h.value, 6) AS match_value FROM m p "
            "LEFT JOIN LATERAL (SELECT reading_id, value FROM m g WHERE g.device_id = p.device_id "
            "AND g.metric = p.metric AND g.ts < p.ts AND NOT g.is_bad "
            "ORDER BY g.ts DESC, g.arrival_seq DESC, g.reading_id DESC LIMIT 1) h ON true"),
        "j3_asof_forward": with_m(
            "SELECT p.reading_id, h.reading_id AS match_id, round(h.value, 6) AS match_value FROM m p "
            "LEFT JOIN LATERAL (SELECT reading_id, value FROM m g WHERE g.device_id = p.device_id "
            "AND g.metric = p.metric AND g.ts > p.ts AND NOT g.is_bad AND NOT g.is_duplicate "
            "ORDER BY g.ts, g.arrival_seq, g.reading_id LIMIT 1) h ON true"),
        "j4_overlay": with_m(
            f", {a1}, {a3}, w AS (SELECT ts, {_sql_pivot('a1')} FROM a1 GROUP BY ts), "
            f"b AS (SELECT ts, {_sql_pivot('a3', 'bad_', True)} FROM a3 GROUP BY ts) "
            f"SELECT {sql_iso('w.ts')} AS ts, {_sql_round_labels()}, {_sql_round_labels('bad_')} "
            "FROM w LEFT JOIN b ON w.ts = b.ts"),
        "f4_legacy_in_series": with_m(
            f", {legacy} SELECT {row_cols} FROM lm WHERE device_id = '{DEVICE}' AND NOT is_duplicate "
            "AND (metric = 'energy_kwh_total' OR metric = 'energy' AND is_bad)"),
        "f5_legacy_in_overlay": with_m(
            f", {legacy} SELECT {sql_iso('b')} AS ts, building_name AS label, round(avg(value), 6) AS value, "
            f"round(sum(coalesce(delta, 0)), 6) AS delta FROM (SELECT *, {sql_bucket('ts', 1440)} AS b FROM lm "
            "WHERE is_bad AND NOT is_duplicate AND metric IN ('energy', 'energy_kwh_total')) "
            "GROUP BY b, building_id, building_name"),
        "f5b_legacy_in_aggregate": with_m(
            f", {legacy} SELECT reading_id, metric, is_bad FROM lm WHERE NOT is_duplicate "
            "AND (metric = 'energy_kwh_total' OR metric = 'energy' AND is_bad)"),
        "a7_scopes": with_m(
            f", {a1}, {a3} SELECT 'aggregate all' AS scope, CAST(count(*) AS DOUBLE) AS result FROM a1 UNION ALL "
            f"SELECT 'aggregate building', count(DISTINCT ts) FROM a1 WHERE building_id = '{BUILDING}' UNION ALL "
            "SELECT 'aggregate device', 0 UNION ALL SELECT 'bad all', count(*) FROM a3 UNION ALL SELECT 'bad building', 0 "
            f"UNION ALL SELECT 'total all wins', round(coalesce(sum(delta), 0), 6) FROM m WHERE {GOOD} UNION ALL "
            f"SELECT 'total device', round(coalesce(sum(delta), 0), 6) FROM m WHERE {GOOD} AND device_id = '{DEVICE}'"),
        "a_rollup": with_m(" UNION ALL ".join([
            "SELECT *, 'all' AS kind FROM (" + _sql_agg(GOOD, ", building_id, building_name", "building_name") + ")",
            "SELECT *, 'building' FROM (" + _sql_agg(f"{GOOD} AND building_id = '{BUILDING}'", "", "'Total'") + ")",
            "SELECT *, 'range' FROM (" + f"SELECT {sql_iso('b')} AS ts, building_name AS label, round(avg(value), 6) AS value, "
            f"round(sum(coalesce(delta, 0)), 6) AS delta FROM (SELECT *, {sql_bucket('ts', 30)} AS b FROM m "
            f"WHERE {GOOD} AND {rng}) GROUP BY b, building_id, building_name)",
            "SELECT *, 'bad' FROM (" + _sql_agg(
                "(metric = 'energy_kwh_total' OR (metric = 'energy' AND is_bad)) AND is_bad AND NOT is_duplicate",
                ", building_id, building_name", "building_name") + ")",
            *[f"SELECT NULL, NULL, NULL, round(coalesce(sum(delta), 0), 6), '{k}' FROM m WHERE {GOOD}{more}" for k, more in (
                ("total", ""), ("total building", f" AND building_id = '{BUILDING}'"), ("total device", f" AND device_id = '{DEVICE}'"),
                ("total range", f" AND {rng}"))]])),
        "c2_spellings": (
            "WITH s AS (SELECT event_id, value, lower(trim(mt)) AS mk, lower(trim(ut)) AS uk, mt, ut FROM (SELECT *, "
            f"({METRICS})[event_id % {len(METRICS)} + 1] AS mt, ({UNITS})[event_id // {len(METRICS)} % {len(UNITS)} + 1] AS ut "
            f"FROM events)), e AS (SELECT *, mk IN {SQL_ENERGY} AS en FROM s) "
            "SELECT event_id, CASE WHEN en THEN 'energy_kwh_total' ELSE mk END AS metric, "
            "CASE WHEN en AND uk IN ('kwh', 'wh') THEN 'kWh' WHEN en THEN ut ELSE uk END AS unit, "
            "round(CASE WHEN en AND uk = 'wh' THEN value / 1000.0 ELSE value END, 6) AS value, en AND uk = 'wh' AS is_normal, "
            "en AND uk NOT IN ('kwh', 'wh') AS is_bad, CASE WHEN event_id % 2 = 0 THEN 'k' || event_id "
            "ELSE sha256(concat_ws('|', event_id, mt, ut, 'x')) END AS dedupe FROM e"),
        "c15_display": with_m(
            "SELECT reading_id, format('{:,.3f}', value) AS value, format('{:,.3f}', delta) AS delta FROM m"),
        "c16_payload_text": (
            "SELECT event_id, CASE WHEN event_type <> 'error' THEN '{\"event_id\":' || event_id || ',\"event_type\":\"' "
            "|| event_type || '\"}' END AS payload, props FROM events"),
        "p3_labels": with_m(
            "SELECT reading_id, CASE reading_id % 3 WHEN 0 THEN device_external_id "
            "WHEN 1 THEN 'name ' || device_external_id ELSE device_id END AS label FROM m"),
        "j5_resolve_devices": with_m(
            ", kn AS (SELECT DISTINCT device_id AS id, device_external_id AS external_id, device_name AS name FROM c), "
            "nw AS (SELECT ' METER-' || c_custkey AS external_id, c_name AS name FROM customer "
            "WHERE 'meter-' || c_custkey NOT IN (SELECT external_id FROM kn)) "
            "SELECT id, external_id, name, false AS is_new FROM kn UNION ALL SELECT "
            + uuid5_sql("'device:' || lower(trim(external_id))") + " AS id, external_id, name, true AS is_new FROM nw"),
        "f6_device_series_range": with_m(device_range),
        "s4_device_range": with_m(device_range),
        "a1_bucketed_range_30min": with_m(
            f"SELECT {sql_iso('b')} AS ts, building_name AS label, round(avg(value), 6) AS value, "
            f"round(sum(coalesce(delta, 0)), 6) AS delta FROM (SELECT *, {sql_bucket('ts', 30)} AS b FROM m "
            f"WHERE {GOOD} AND {rng}) GROUP BY b, building_id, building_name"),
        "a4_total_range": with_m(
            f"SELECT round(coalesce(sum(delta), 0), 6) AS sum_delta FROM m WHERE {GOOD} AND {rng}"),
        "o1_recent_offset": with_m(
            f"SELECT {row_cols} FROM m WHERE device_id = '{DEVICE}' AND metric = 'energy_kwh_total' AND NOT is_bad "
            f"{recent_order} LIMIT 10 OFFSET 20"),
        "h1_device_chart_rolling_avg": with_m(
            f"SELECT id, {sql_iso('ts')} AS ts, round(v, 6) AS value, round(CASE WHEN NOT is_bad THEN v END, 6) "
            "AS mainValue, round(CASE WHEN is_late THEN v END, 6) AS lateValue "
            f"FROM (SELECT reading_id AS id, ts, is_bad, is_late, "
            f"{_sql_rolling('m', 'avg(value)', 'device_id', 120)} AS v FROM m "
            f"WHERE {series_where} AND NOT is_bad AND {rng})"),
        "h4_series_per_building_raw": with_m(
            f", {a1} SELECT label AS building, {sql_iso('ts')} AS ts, round(coalesce(value, 0), 6) AS value FROM a1"),
        "h2_building_chart": with_m(
            f"SELECT {sql_iso('ts')} AS ts, {label} AS label, round(arg_max(delta, arrival_seq), 6) AS value "
            f"FROM m WHERE {bseries} GROUP BY ts, {label}"),
        "j5_resolve_buildings": with_m(
            ", kn AS (SELECT DISTINCT building_id AS id, building_name AS name FROM m), "
            "inc AS (SELECT upper(building_name) AS name FROM r UNION ALL SELECT n_name AS name FROM nation), "
            "nw AS (SELECT lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g')) AS k, min(name) AS name FROM inc "
            "GROUP BY 1 HAVING k NOT IN (SELECT lower(name) FROM kn)) "
            "SELECT id, name, false AS is_new FROM kn UNION ALL "
            "SELECT " + uuid5_sql("'building:' || k") + " AS id, name, true AS is_new FROM nw"),
    }
