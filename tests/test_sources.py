import json
import os
import tempfile

from pyspark.sql import functions as F

import fixtures as fx
from wattline.operators.measure import derive_measurements
from wattline.sources.batches import load_measurements, read_batches
from wattline.streaming.ingest import ingest_stream


def write_batch(folder, batch_id, batch, corrupt=False):
    d = os.path.join(folder, f"batch_id={batch_id}")
    os.makedirs(d, exist_ok=True)
    body = {"building": {"name": batch["building"]},
            "device": {"external_id": batch["ext"], "name": batch.get("name")},
            "readings": [{"timestamp": ts.strftime("%Y-%m-%dT%H:%M:%SZ"), "metric": m, "value": v, "unit": u,
                          "raw_payload": {"src": "test"}} for ts, m, v, u in batch["rows"]]}
    with open(os.path.join(d, "part.json"), "w") as f:
        f.write(json.dumps(body) + "\n")
        if corrupt:
            f.write("{not json\n")


def as_rows(m):
    return sorted((r.device_external_id, r.ts, r.value, r.is_duplicate, r.is_late, r.is_reset, r.delta) for r in m.collect())


def test_read_batches_keeps_order_and_skips_corrupt(spark):
    folder = tempfile.mkdtemp(prefix="wl-batches-")
    for i, b in enumerate(fx.SAMPLE):
        write_batch(folder, i, b, corrupt=(i == 0))
    r = read_batches(spark, folder)
    assert r.count() == fx.ROWS
    first = r.orderBy("arrival_seq").first()
    assert first.device_external_id == "pump" and first.value == 0.0
    m = derive_measurements(r)
    expected = derive_measurements(fx.readings(spark, fx.SAMPLE))
    assert as_rows(m) == as_rows(expected)
    assert r.where(F.col("raw_payload").isNotNull()).count() == fx.ROWS


def test_stream_in_two_runs_equals_one_shot(spark):
    root = tempfile.mkdtemp(prefix="wl-stream-")
    inbox, log, out, ck = (os.path.join(root, x) for x in ("in", "log", "out", "ck"))
    os.makedirs(inbox)

    def drop(i, b):
        with open(os.path.join(inbox, f"{i:04d}.json"), "w") as f:
            write_body = {"building": {"name": b["building"]}, "device": {"external_id": b["ext"]},
                          "readings": [{"timestamp": ts.strftime("%Y-%m-%dT%H:%M:%SZ"), "metric": m, "value": v,
                                        "unit": u} for ts, m, v, u in b["rows"]]}
            f.write(json.dumps(write_body) + "\n")

    for i, b in enumerate(fx.SAMPLE[:3]):
        drop(i, b)
    ingest_stream(spark, inbox, log, ck, out_path=out).awaitTermination()
    for i, b in enumerate(fx.SAMPLE[3:], start=3):
        drop(i, b)
    ingest_stream(spark, inbox, log, ck, out_path=out).awaitTermination()
    got = load_measurements(spark, out)
    assert got.count() == fx.ROWS
    expected = derive_measurements(fx.readings(spark, fx.SAMPLE))
    key = ["device_external_id", "ts", "is_duplicate"]
    a = sorted((r.device_external_id, r.ts, r.is_duplicate, r.is_late, r.is_reset, r.delta) for r in got.select(*key, "is_late", "is_reset", "delta").collect())
    e = sorted((r.device_external_id, r.ts, r.is_duplicate, r.is_late, r.is_reset, r.delta) for r in expected.select(*key, "is_late", "is_reset", "delta").collect())
    assert a == e


def test_refresh_rewrites_only_touched_buckets(spark):
    import glob

    from wattline.sources.batches import append_log, parse_batches
    from wattline.streaming.ingest import refresh
    root = tempfile.mkdtemp(prefix="wl-refresh-")
    log, out = os.path.join(root, "log"), os.path.join(root, "out")

    def batch_df(i, b):
        body = [({"name": b["building"]}, {"external_id": b["ext"], "name": None},
                 [{"timestamp": ts.strftime("%Y-%m-%dT%H:%M:%SZ"), "metric": m, "value": v, "unit": u,
                   "dedupe_key": None, "raw_payload": None} for ts, m, v, u in b["rows"]])]
        from wattline.schemas import BATCH
        schema = BATCH["building"], BATCH["device"], BATCH["readings"]
        from pyspark.sql import types as T
        return parse_batches(spark.createDataFrame(body, T.StructType(list(schema))), i, sum(len(x["rows"]) for x in fx.SAMPLE[:i]))

    first = fx.SAMPLE[:5]
    for i, b in enumerate(first):
        append_log(batch_df(i, b), log, buckets=8)
    refresh(spark, log, out, range(8), buckets=8)
    before = {p: os.path.getmtime(p) for p in glob.glob(os.path.join(out, "bucket=*", "*", "*.parquet"))}
    assert before
    last = fx.SAMPLE[5]
    new = batch_df(5, last)
    append_log(new, log, buckets=8)
    from wattline.sources.batches import series_bucket
    touched = [r[0] for r in new.select(series_bucket(8)).distinct().collect()]
    refresh(spark, log, out, touched, buckets=8)
    after = {p: os.path.getmtime(p) for p in glob.glob(os.path.join(out, "bucket=*", "*", "*.parquet"))}
    for p, t in before.items():
        if not any(f"bucket={b}/" in p for b in touched):
            assert after.get(p) == t  # untouched bucket files kept as they were
    got = load_measurements(spark, out)
    expected = derive_measurements(fx.readings(spark, fx.SAMPLE))
    key = lambda df: sorted((r.device_external_id, r.ts, r.is_duplicate, r.is_late, r.delta) for r in df.collect())
    assert key(got) == key(expected)


def test_unparseable_timestamp_is_quarantined(spark):
    from wattline.operators.measure import invalid_readings
    folder = tempfile.mkdtemp(prefix="wl-badts-")
    d = os.path.join(folder, "batch_id=0")
    os.makedirs(d)
    body = {"building": {"name": "B"}, "device": {"external_id": "d1"},
            "readings": [{"timestamp": "2024-03-01T08:00:00+02:00", "metric": "energy", "value": 1, "unit": "kWh"},
                         {"timestamp": "not-a-time", "metric": "energy", "value": 2, "unit": "kWh"},
                         {"timestamp": "2024-03-01T06:00:00Z", "metric": "energy", "value": 3, "unit": "kWh"}]}
    with open(os.path.join(d, "part.json"), "w") as f:
        f.write(json.dumps(body) + "\n")
    r = read_batches(spark, folder)
    m = derive_measurements(r).collect()
    assert len(m) == 2
    # +02:00 and Z are the same instant: the second arrival is a duplicate
    assert sorted(x.is_duplicate for x in m) == [False, True]
    bad = invalid_readings(r).collect()
    assert [(x.value, x.reason) for x in bad] == [(2.0, "timestamp")]


def _bodies():
    good = {"building": {"name": "B"}, "device": {"external_id": "d1"},
            "readings": [{"timestamp": "2024-03-01T08:00:00Z", "metric": "energy", "value": 1, "unit": "kWh"}]}
    text_value = {**good, "readings": good["readings"] + [{"timestamp": "2024-03-01T09:00:00Z", "metric": "energy", "value": "x", "unit": "kWh"}]}
    no_list = {"building": {"name": "B"}, "device": {"external_id": "d2"}}
    no_device = {**good, "device": {"name": "n"}}
    no_building = {**good, "building": {}, "device": {"external_id": "d3"}}
    return good, text_value, no_list, no_device, no_building


def test_rejected_bodies_and_missing_ids_are_visible(spark):
    from wattline.operators.measure import invalid_readings
    from wattline.sources.batches import read_bodies, rejected_bodies
    folder = tempfile.mkdtemp(prefix="wl-rejected-")
    for i, body in enumerate(_bodies()):
        d = os.path.join(folder, f"batch_id={i}")
        os.makedirs(d)
        with open(os.path.join(d, "part.json"), "w") as f:
            f.write(json.dumps(body) + "\n")
    got = {r.reason: (r.body, r.file) for r in rejected_bodies(read_bodies(spark, folder)).collect()}
    assert set(got) == {"malformed", "no readings"}
    assert json.loads(got["malformed"][0]) == _bodies()[1] and "batch_id=1" in got["malformed"][1]
    r = read_batches(spark, folder)
    assert sorted(x.reason for x in invalid_readings(r).collect()) == ["building", "device"]
    m = derive_measurements(r).collect()
    assert [(x.device_external_id, x.delta) for x in m] == [("d1", None)]
    # the time of ingest is the file's, so a second read repeats it
    assert r.select("ingest_time").collect() == read_batches(spark, folder).select("ingest_time").collect()


def test_stream_writes_rejected_bodies(spark):
    root = tempfile.mkdtemp(prefix="wl-stream-rejected-")
    inbox, log, out, ck, bad = (os.path.join(root, x) for x in ("in", "log", "out", "ck", "bad"))
    os.makedirs(inbox)
    for i, body in enumerate(_bodies()):
        with open(os.path.join(inbox, f"{i}.json"), "w") as f:
            f.write(json.dumps(body) + "\n")
    ingest_stream(spark, inbox, log, ck, out_path=out, rejected_path=bad, max_files=2).awaitTermination()
    assert sorted(r.reason for r in spark.read.parquet(bad).collect()) == ["malformed", "no readings"]
    assert [r.device_external_id for r in load_measurements(spark, out).collect()] == ["d1"]


def _body(device, *readings):
    return {"building": {"name": "B"}, "device": {"external_id": device},
            "readings": [{"timestamp": f"2024-03-01T{hhmm}:00Z", "metric": "energy", "value": v, "unit": "kWh"}
                         for hhmm, v in readings]}


def _write_lines(path, *bodies):
    with open(path, "w") as f:
        f.writelines((b if isinstance(b, str) else json.dumps(b)) + "\n" for b in bodies)


def test_bodies_of_one_device_in_one_file_keep_their_order(spark):
    folder = tempfile.mkdtemp(prefix="wl-bodies-")
    os.makedirs(os.path.join(folder, "batch_id=10"))
    os.makedirs(os.path.join(folder, "batch_id=9"))
    _write_lines(os.path.join(folder, "batch_id=10", "a.json"), _body("d2", ("08:00", 9.0)))
    _write_lines(os.path.join(folder, "batch_id=9", "a.json"), _body("d1", ("08:00", 1.0)), "{not json",
                 _body("d1", ("08:00", 2.0), ("08:10", 5.0)))
    m = derive_measurements(read_batches(spark, folder)).orderBy("arrival_seq").collect()
    assert [(r.reading_id, r.device_external_id, r.value, r.is_duplicate, r.delta) for r in m] == [
        (0, "d1", 1.0, False, None), (1, "d1", 2.0, True, None), (2, "d1", 5.0, False, 4.0), (3, "d2", 9.0, False, None)]


def test_order_holds_over_many_splits_of_a_file(spark):
    folder = tempfile.mkdtemp(prefix="wl-splits-")
    os.makedirs(os.path.join(folder, "batch_id=0"))
    _write_lines(os.path.join(folder, "batch_id=0", "a.json"), *[_body(f"d{i}", ("08:00", float(i))) for i in range(500)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        r = read_batches(spark, folder)
        assert [(x.reading_id, x.value) for x in r.orderBy("reading_id").collect()] == [(i, float(i)) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_triggers_number_on_and_a_replay_repeats(spark):
    from wattline.sources.batches import load_log, read_bodies
    from wattline.streaming.ingest import process_batch
    root = tempfile.mkdtemp(prefix="wl-triggers-")
    files = [os.path.join(root, f"{i}.json") for i in range(3)]
    _write_lines(files[0], _body("d1", ("08:00", 1.0), ("08:20", 3.0)))
    _write_lines(files[1], "{not json")  # a trigger without a reading
    _write_lines(files[2], _body("d1", ("08:10", 2.0)), _body("d1", ("08:10", 7.0)))
    log, out, raw = (os.path.join(root, x) for x in ("log", "out", "raw"))
    start = (1 << 19) - 1

    def trigger(k):
        process_batch(spark, read_bodies(spark, files[k]), start + k, log, out, raw, "event_time", 4)

    def state():
        return sorted((r.reading_id, r.value, r.is_duplicate, r.is_late, r.delta) for r in load_measurements(spark, out).collect())

    for k in range(3):
        trigger(k)
    expected = [(0, 1.0, False, False, None), (1, 3.0, False, False, 1.0), (2, 2.0, False, True, 1.0), (3, 7.0, True, True, None)]
    assert state() == expected
    for k in (0, 2):
        trigger(k)
    assert state() == expected
    assert sorted(r.id for r in spark.read.parquet(raw).collect()) == [0, 1, 2, 3]
    assert load_log(spark, log).count() == 4


def test_batch_without_a_number_fails(spark):
    import pytest
    folder = tempfile.mkdtemp(prefix="wl-null-batch-")
    _write_lines(os.path.join(folder, "a.json"), _body("d1", ("08:00", 1.0)))
    with pytest.raises(Exception, match="batch without a number"):
        read_batches(spark, folder, F.lit(None)).collect()


def test_checkpoint_folder_is_required_on_a_cluster():
    import pytest
    from types import SimpleNamespace as N
    from wattline.session import ensure_checkpoint_dir
    unset = N(conf=N(get=lambda key, default: default), sparkContext=N(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(unset)


def test_delivered_files_hold_many_blocks_in_their_order(spark):
    """Files do not grow with the blocks, and the numbers are those of one file a block."""
    import glob
    import __spark_entry__ as E
    from wattline.sources.batches import read_batches, write_batches
    rows = [(b, p, {"name": "B"}, {"external_id": f"d{d}", "name": None},
             [{"timestamp": "2024-01-01T00:00:00Z", "metric": "energy", "value": float(100 * b + 10 * d + p), "unit": "kWh"}] * (1 + p))
            for b in range(100) for d in range(2) for p in range(2)]
    reading = "struct<timestamp: string, metric: string, value: double, unit: string>"
    batches = spark.createDataFrame(rows, f"block long, part int, building struct<name: string>, device struct<external_id: string, name: string>, "
                                          f"readings array<{reading}>")
    one, many = tempfile.mkdtemp(prefix="wl-file-"), tempfile.mkdtemp(prefix="wl-file-")
    write_batches(batches, one)
    E._deliver(batches, many)
    assert len(glob.glob(f"{one}/*/*.json")) == 100 and len(glob.glob(f"{many}/*/*.json")) == 4
    numbers = lambda path: sorted((r.reading_id, r.value) for r in read_batches(spark, path).collect())
    assert numbers(many) == numbers(one) and len(numbers(one)) == 600
