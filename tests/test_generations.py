"""The stored table of a stream: slices, generations and the segmented log."""

import datetime as dt
import os
import random
import tempfile

import pytest

from wattline.operators.measure import derive_measurements
from wattline.schemas import MEASUREMENT_COLUMNS
from wattline.sources.batches import append_log, load_log, load_measurements
from wattline.sources.manifest import Manifest
from wattline.sources.segments import due, live_segments, rows_before
from wattline.streaming.generations import current, refresh_slices

DAY = dt.datetime(2024, 3, 1)


def reading(seq, device, minutes, value, unit="kWh", metric="energy"):
    return (seq, seq, "B1", device, None, DAY + dt.timedelta(minutes=minutes), metric, value, unit, None, None, DAY)


def batches_of(spark, parts):
    """Lists of (device, minutes, value, unit) as micro-batches with arrival numbers going on."""
    seq, out = 0, []
    for k, part in enumerate(parts):
        rows = []
        for device, minutes, value, unit in part:
            rows.append((*reading(seq, device, minutes, value, unit), k))
            seq += 1
        out.append(spark.createDataFrame(
            rows, "reading_id long, arrival_seq long, building_name string, device_external_id string, device_name string, ts timestamp, "
                  "metric string, value double, unit string, dedupe_key string, raw_payload string, ingest_time timestamp, batch_id long"))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*MEASUREMENT_COLUMNS).collect()), key=lambda r: r[1])


def whole(spark, batches, mode):
    df = batches[0]
    for b in batches[1:]:
        df = df.unionByName(b)
    return rows_of(derive_measurements(df, mode))


def random_parts(seed, n_parts, size, days):
    """In-order and late readings over many slices, gaps, copies at one time, bad units, and values that fall."""
    rng, out, now = random.Random(seed), [], 0
    for _ in range(n_parts):
        part = []
        for _ in range(size):
            now += rng.choice([0, 30, 60, 700])
            at = now if rng.random() < 0.6 else rng.randrange(0, min(now, days * 1440) + 1, 30)
            part.append((f"d{rng.randrange(2)}", at, float(rng.randrange(0, 12)), rng.choice(["kWh", "kWh", "kWh", "Wh", "kals"])))
        out.append(part)
    return out


@pytest.mark.parametrize("mode,seed", [("event_time", 1), ("arrival", 5)])
def test_triggers_give_what_one_derivation_gives(spark, mode, seed):
    path = tempfile.mkdtemp(prefix="wl-gen-")
    batches = batches_of(spark, random_parts(seed, 3, 30, 12))
    for k, b in enumerate(batches):
        refresh_slices(spark, b, path, k, mode, buckets=2, hours=24)
        if k:
            assert rows_of(load_measurements(spark, path)) == whole(spark, batches[:k + 1], mode)


@pytest.mark.parametrize("mode", ["event_time", "arrival"])
def test_late_repair_across_triggers_slices_and_gaps(spark, mode):
    """Late good, bad and repeated readings in empty slices far from their neighbours; a replay."""
    path, day = tempfile.mkdtemp(prefix="wl-late-"), 1440
    parts = [[("d", 0, 0.0, "kWh"), ("d", 40 * day, 30.0, "kWh"), ("e", 5, 1.0, "kWh")],
             [("d", 20 * day, 10.0, "kWh")],                                   # good, in a slice of its own
             [("d", 30 * day, 7.0, "kals"), ("d", 30 * day + 5, 99.0, "kals")],  # bad ones before the last
             [("d", 10 * day, 4.0, "kWh"), ("d", 10 * day, 5.0, "kWh"), ("d", 20 * day, 11.0, "kWh")],
             [("d", 35 * day, 20.0, "kWh"), ("d", 41 * day, 31.0, "kWh"), ("d", 40 * day + 1, 2.0, "kWh"), ("d", 30 * day, 8.0, "kWh")]]
    batches = batches_of(spark, parts)
    for k, b in enumerate(batches):
        refresh_slices(spark, b, path, k, mode, buckets=2, hours=24)
        if k in (2, 3):
            assert rows_of(load_measurements(spark, path)) == whole(spark, batches[:k + 1], mode)
    for k in (1, 4):
        refresh_slices(spark, batches[k], path, k, mode, buckets=2, hours=24)
    assert rows_of(load_measurements(spark, path)) == whole(spark, batches, mode)


def test_a_refresh_reads_slices_and_not_history(spark):
    """The same trigger after a short and after a ten times longer history reads the same rows."""
    def history(days):
        path = tempfile.mkdtemp(prefix="wl-cost-")
        parts = [[("d", 1440 * day + 60 * h, float(day), "kWh") for day in range(-days, 0) for h in range(6)],
                 [("d", 1440 * 0 + 5, 1.0, "kWh")], [("d", -1440 - 1, 2.0, "kWh")]]
        return [refresh_slices(spark, b, path, k, buckets=1, hours=24) for k, b in enumerate(batches_of(spark, parts))], path
    short, _ = history(6)
    long, path = history(60)
    assert short[1:] == long[1:] and long[0]["parts_written"] == 60
    assert long[1] == {"rows_read": 0, "parts_read": 0, "parts_written": 1}
    assert long[2]["rows_read"] == 12 and long[2]["parts_read"] == 2
    store = current(spark, path)
    assert sorted({g for g, _ in store.parts.values()}) == [0, 1, 2]


def test_reads_of_a_stream_table_open_their_slices_only(spark):
    path = tempfile.mkdtemp(prefix="wl-read-")
    parts = [[(f"d{d}", 1440 * day, float(day), "kWh") for day in range(5) for d in range(6)]]
    refresh_slices(spark, batches_of(spark, parts)[0], path, 0, buckets=4, hours=24)
    device = rows_of(load_measurements(spark, path))[0][4]
    got = load_measurements(spark, path, device, start=DAY + dt.timedelta(days=1), end=DAY + dt.timedelta(days=2, minutes=1))
    parts = {os.path.dirname(f) for f in got.inputFiles()}  # two slices of the bucket, and of the legacy name's bucket
    assert {p[-5:] for p in parts} == {"19784", "19785"} and len(parts) <= 4 and got.count() == 2


def test_old_generations_go_when_no_reader_can_still_need_them(spark):
    path = tempfile.mkdtemp(prefix="wl-old-")
    for k, b in enumerate(batches_of(spark, [[("d", k, float(k), "kWh")] for k in range(4)])):
        refresh_slices(spark, b, path, k, buckets=1, hours=24)
    live = [f for f in os.listdir(os.path.join(path, "rows")) if os.path.exists(os.path.join(path, "rows", f, "p_bucket=0", "p_slice=19783"))]
    assert sorted(live) == ["generation=2", "generation=3"]
    assert Manifest(spark, path).versions() == [2, 3]


def test_a_part_and_a_segment_are_written_by_one_run_of_their_plan(spark):
    """Each row is made once: no sampling run of the whole plan before the write."""
    from pyspark.sql import functions as F
    from wattline.schemas import LOG
    from wattline.sources import segments
    from wattline.streaming import generations as g
    made = spark.sparkContext.accumulator(0)

    def count(n):
        made.add(1)
        return n
    counted = F.udf(count, "long").asNondeterministic()
    df = spark.range(0, 500, 1, 4).select((F.col("id") % 3).alias("bucket"), F.lit(0).cast("long").alias("slice"), counted("id").alias("n"))
    path = tempfile.mkdtemp(prefix="wl-once-")
    g._write(df, f"{path}/parts", ["bucket", "slice"], ["n"])
    assert made.value == 500
    back = spark.read.schema("bucket long, slice long, n long").parquet(f"{path}/parts/p_bucket=1/p_slice=0")
    assert sorted(r.n for r in back.collect()) == list(range(1, 500, 3))
    log = spark.range(0, 500, 1, 4).select(*[(counted("id") if f.name == "reading_id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in LOG])
    segments._write(log, f"{path}/log")
    assert made.value == 1000 and spark.read.parquet(f"{path}/log").count() == 500


def test_states_are_made_from_the_derived_rows_only(spark, monkeypatch):
    """Series of a touched part that a trigger does not touch keep their states; their rows are not grouped again."""
    import wattline.streaming.generations as g
    path = tempfile.mkdtemp(prefix="wl-states-")
    batches = batches_of(spark, [[(f"d{d}", 10 * i, float(i), "kWh") for d in range(6) for i in range(5)], [("d3", 55, 9.0, "kWh")]])
    grouped, own = [], g.own_states
    monkeypatch.setattr(g, "own_states", lambda rows: grouped.append(rows.count()) or own(rows))
    for k, b in enumerate(batches):
        refresh_slices(spark, b, path, k, buckets=1, hours=24)
    assert grouped == [30, 6]
    assert rows_of(load_measurements(spark, path)) == whole(spark, batches, "event_time")
    store = current(spark, path)
    assert store.states(store.parts).count() == 6 and {r["orig"]["value"] for r in store.states(store.parts).collect()} == {4.0, 9.0}


# -- the log -----------------------------------------------------------------

def test_log_of_many_batches_is_few_segments(spark, monkeypatch):
    import wattline.sources.segments as segments
    monkeypatch.setattr(segments.append_segment, "__defaults__", (3, 1 << 30))
    path = tempfile.mkdtemp(prefix="wl-log-")
    batches = batches_of(spark, [[("d", 60 * k + i, float(i), "kWh") for i in range(2)] if k != 4 else [] for k in range(11)])
    for k, b in enumerate(batches):
        assert rows_before(spark, path, k) == 2 * (k - (k > 4))
        append_log(b, path, 4, batch_id=k)
        if k in (2, 4, 9):
            assert sorted(r.reading_id for r in load_log(spark, path).collect()) == list(range(2 * (k + 1 - (k >= 4))))
    assert [s["level"] for s in live_segments(spark, path)] == [2, 0]
    append_log(batches[10], path, 4, batch_id=10)  # a replay of the last
    append_log(batches[3], path, 4, batch_id=3)    # and of an old one
    assert sorted(r.reading_id for r in load_log(spark, path).collect()) == list(range(20))
    assert len({os.path.dirname(f) for f in load_log(spark, path).inputFiles()}) == 2
    folders = [d for level in os.listdir(path) if level.startswith("level-") for d in os.listdir(os.path.join(path, level))]
    assert len(folders) <= 6  # live ones and those that the version before still names


def test_a_thousand_triggers_leave_a_bounded_number_of_segments():
    segments, most, rewritten = [], 0, 0
    for k in range(1000):
        segments.append({"level": 0, "first": k, "last": k, "rows": 5})
        while side := due(segments, 8, 1 << 30):
            at = segments.index(side[0])
            segments[at:at + 8] = [{"level": side[0]["level"] + 1, "first": side[0]["first"], "last": side[-1]["last"], "rows": sum(s["rows"] for s in side)}]
            rewritten += segments[at]["rows"]
        most = max(most, len(segments))
    assert most <= 7 * 4 and rewritten <= 3 * 5000
    assert [s["first"] for s in segments] == [0, *[s["last"] + 1 for s in segments[:-1]]] and segments[-1]["last"] == 999


def test_large_segments_are_not_merged_again():
    big = [{"level": 1, "rows": 60} for _ in range(8)]
    assert due(big, 8, 400) == [] and len(due(big, 8, 480)) == 8


# -- existence probe -----------------------------------------------------------

def test_probe_of_the_stored_table_reads_only_parts_that_may_hold_a_key(spark, monkeypatch):
    import wattline.streaming.generations as g
    from wattline.operators.measure import normalize
    path = tempfile.mkdtemp(prefix="wl-probe-")
    stored = [(f"d{d}", 1440 * day + 10 * i, float(i), "kals" if i == 3 else "kWh") for d in range(3) for day in range(4) for i in range(40)]
    first, batch = batches_of(spark, [stored, [("d1", 1440 * 2 + 30, 5.0, "kWh"), ("d1", 1440 * 2 + 30, 6.0, "kWh"), ("d2", 1440 + 5, 1.0, "kWh"),
                                               ("d9", 0, 1.0, "kWh"), ("d0", 1440 * 9, 1.0, "kWh"), ("D0 ", 10, 1.0, "Wh")]])
    refresh_slices(spark, first, path, 0, buckets=2, hours=24)
    asked, read = [], g.Store.rows
    monkeypatch.setattr(g.Store, "rows", lambda self, parts: asked.append(list(parts)) or read(self, parts))
    probes = normalize(batch)
    got = sorted((r.device_external_id, r.value) for r in g.existing_stored(spark, probes, path).collect())
    assert got == [("D0 ", 0.001), ("d1", 5.0), ("d1", 6.0)]
    assert len(asked[0]) == 2  # d2's and d9's keys are in no filter; d0's ninth day is not stored
    assert g.existing_stored(spark, probes, tempfile.mkdtemp()).count() == 0


def test_filters_miss_nothing_and_rarely_err(spark):
    import wattline.streaming.generations as g
    path = tempfile.mkdtemp(prefix="wl-bloom-")
    rows = [("d", 2 * i, 0.0, "kWh") for i in range(3000)]
    refresh_slices(spark, batches_of(spark, [rows])[0], path, 0, buckets=1, hours=24 * 365)
    from wattline.operators.measure import normalize
    both = normalize(batches_of(spark, [[("d", i, 0.0, "kWh") for i in range(6000)]])[0])
    assert g.existing_stored(spark, both, path).count() == 3000
    from pyspark.sql import functions as F
    store = g.current(spark, path)
    keys = both.select("device_id", "metric", "ts").withColumn("blocks", g._blocks_of(F.lit(3000)))
    bits = {}
    for r in store.filters(store.parts).collect():
        bits[r["block"]] = r["bits"]
    hits = {}
    for r in g._spots(keys).collect():
        hits[r["ts"]] = hits.get(r["ts"], True) and bool(bits.get(r["block"], b"\0" * 4096)[r["bit"] // 8] >> (r["bit"] % 8) & 1)
    assert sum(hits.values()) < 3000 + 100


# -- rollup ----------------------------------------------------------------------

def test_rollup_answers_as_the_rows_do_after_late_repairs(spark):
    from wattline.plans import queries as q, rollup
    path = tempfile.mkdtemp(prefix="wl-rollup-")
    batches = batches_of(spark, random_parts(11, 2, 60, 8))
    for k, b in enumerate(batches):
        refresh_slices(spark, b, path, k, buckets=2, hours=24)
    m = derive_measurements(batches[0].unionByName(batches[1])).cache()
    b1 = m.first()["building_id"]
    rows = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()]
    ranges = [(None, None), (DAY + dt.timedelta(minutes=31), DAY + dt.timedelta(days=3, minutes=59, seconds=59)),
              (DAY, DAY + dt.timedelta(days=2) - dt.timedelta(microseconds=1)), (DAY + dt.timedelta(hours=2, minutes=1), DAY + dt.timedelta(hours=2, minutes=9))]
    for start, end in ranges:
        for minutes in (60, 7) if start == DAY else (60,):
            want = q.aggregated(m, start=start, end=end, minutes=minutes)
            assert rows(rollup.aggregated(spark, path, start=start, end=end, minutes=minutes).select(*want.columns)) == rows(want)
        want = q.bad_points(m, start=start, end=end, minutes=30)
        assert rows(rollup.bad_points(spark, path, start=start, end=end, minutes=30).select(*want.columns)) == rows(want)
        assert rows(rollup.sum_deltas(spark, path, start=start, end=end)) == rows(q.sum_deltas(m, start=start, end=end))
    want = q.aggregated(m, b1)
    assert rows(rollup.aggregated(spark, path, b1).select(*want.columns)) == rows(want)
    assert rollup.aggregated(spark, path, b1, "x").count() == 0 and rollup.bad_points(spark, path, b1).count() == 0
    device = m.first()["device_id"]
    for args in ({"building": b1}, {"building": b1, "device": device}, {"building": "none"}):
        assert rows(rollup.sum_deltas(spark, path, **args)) == rows(q.sum_deltas(m, **args))


def test_newest_page_opens_few_slices(spark, monkeypatch):
    import wattline.streaming.generations as g
    from wattline.plans import queries as q, rollup
    path = tempfile.mkdtemp(prefix="wl-page-")
    rows = [("d", 1440 * day + 10 * i, float(i), "kals" if i == 2 else "kWh") for day in range(30) for i in range(8)] + [("d", 0, 5.0, "kWh")]
    b = batches_of(spark, [rows])[0]
    refresh_slices(spark, b, path, 0, buckets=1, hours=24)
    m = derive_measurements(b)
    device = m.first()["device_id"]
    asked, read = [], g.Store.rows
    monkeypatch.setattr(g.Store, "rows", lambda self, parts: asked.append(len(parts)) or read(self, parts))
    for limit, offset, bad, opened in ((5, 0, True, 1), (20, 0, False, 3), (20, 40, True, 15), (100, 500, True, 30)):
        asked.clear()
        got = rollup.recent(spark, path, device, limit=limit, offset=offset, exclude_bad=bad)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in q.recent(m, device, limit=limit, offset=offset, exclude_bad=bad).collect()]
        assert max(asked) == opened


# -- dimension -------------------------------------------------------------------

def test_dimension_kept_over_triggers(spark):
    from wattline.functions.keys import device_key
    from wattline.operators.dims import load_dimension, upsert_dimension
    from wattline.sources.manifest import Manifest
    from pyspark.sql import functions as F
    path = tempfile.mkdtemp(prefix="wl-dim-")
    parts = [["a", "B "], [" A", "c"], [], ["b", "C", "d"], *[[f"x{k}", "a"] for k in range(8)]]
    frames = [spark.createDataFrame([(x, f"name {k}", 1) for x in p], "external_id string, name string, extra int") for k, p in enumerate(parts)]
    for k in (0, 1, 1, 2, 0, 3, *range(4, 12), 11):
        upsert_dimension(spark, frames[k], path, k, "device")
    got = {r.external_id: (r.id, r.name) for r in load_dimension(spark, path, "device").collect()}
    assert {k: v[1] for k, v in got.items()} == {"a": "name 0", "B ": "name 0", "c": "name 1", "d": "name 3", **{f"x{k}": f"name {k + 4}" for k in range(8)}}
    assert got["B "][0] == spark.range(1).select(device_key(F.lit("b"))).first()[0]
    assert len(Manifest(spark, path).load()[1]["segments"]) < 8
