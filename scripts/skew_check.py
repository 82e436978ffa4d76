"""Skew demonstration (not a registered query): readings derived from
``events`` are remapped so one device holds a third of all readings and one
(device, ts) copy group a sixth; the event-time derivation runs with an event
log, and the largest single task's share of each shuffle stage's records is
printed.  Usage: python scripts/skew_check.py [sf_dir] [event_time|arrival] [arrival_slice_bits]"""

import glob
import io
import json
import sys
import tempfile

sys.path.insert(0, ".")

import zstandard  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wattline.operators.measure import derive_measurements  # noqa: E402
from wattline.session import get_session  # noqa: E402
from wattline.sources.tables import readings_from_events  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    mode = sys.argv[2] if len(sys.argv) > 2 else "event_time"
    bits = int(sys.argv[3]) if len(sys.argv) > 3 else 20
    log_dir = tempfile.mkdtemp(prefix="wattline-skew-")
    # No broadcasts and no partition coalescing, so every shuffle shows its
    # real key distribution; AQE's skew-join thresholds are scaled down from
    # 256 MB to this data size so the split of a hot join key is visible.
    spark = get_session(shuffle_partitions=16, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB"})
    r = readings_from_events(spark, sf)
    hot = F.col("reading_id") % 3 == 0
    copies = F.col("reading_id") % 6 == 0
    r = (r.withColumn("device_external_id", F.when(hot, F.lit("meter-hot")).otherwise(F.col("device_external_id")))
          .withColumn("ts", F.when(copies, F.lit("2024-01-15 00:00:00").cast("timestamp")).otherwise(F.col("ts"))))
    total = r.count()
    derive_measurements(r, mode, arrival_slice_bits=bits).write.format("noop").mode("overwrite").save()
    spark.stop()
    stages = {}
    for path in glob.glob(f"{log_dir}/*/events*") + glob.glob(f"{log_dir}/events*"):
        raw = open(path, "rb").read()
        text = (zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read().decode()
                if path.endswith("zstd") else raw.decode())
        for line in text.splitlines():
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if e.get("Event") != "SparkListenerTaskEnd":
                continue
            m = e.get("Task Metrics") or {}
            n = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
            stages.setdefault(e["Stage ID"], []).append(n)
    print(f"{mode}: readings: {total}; hot device: 1/3 of them; one copy group: 1/6")
    print("| stage | tasks | shuffle records read | largest task | share |")
    print("|---|---|---|---|---|")
    for sid in sorted(stages):
        recs = stages[sid]
        tot = sum(recs)
        if tot < 1000:
            continue
        print(f"| {sid} | {len(recs)} | {tot} | {max(recs)} | {max(recs) / tot:.2f} |")


if __name__ == "__main__":
    main()
