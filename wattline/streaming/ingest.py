"""Continuous ingest (R1) with incremental refresh (R2); duplicate and late flags
on a stream (R3, R4) come from the refresh, which derives touched slices.

The reference applies every request at once and repairs the successor of any
late reading however old, so there is no watermark to bound state: a late
reading can change a delta computed long ago.  The streaming job therefore

1. reads new batch files with an explicit schema (file source, exactly once
   through the checkpoint);
2. in ``foreachBatch`` flattens them, numbers their readings on from the count of
   the batches before and appends them to the log as one segment (a replay
   repeats the same numbers, never duplicates);
3. takes them into the measurement table: only the time slices they touch are
   derived and written, as a new generation (``generations.py``).

Flags are kept on every reading (nothing is dropped as a duplicate), and
lateness is measured against the running maximum of good originals, as in the
batch derivation, not against a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.measure import derive_measurements
from ..schemas import BATCH
from ..sources.batches import (DEFAULT_BUCKETS, append_log, append_raw, append_rejected, load_log, parse_batches,
                               with_origin, write_measurements)
from ..sources.segments import rows_before
from .generations import SLICE_HOURS, refresh_slices

MAX_FILES_PER_TRIGGER = 1000


def refresh(spark: SparkSession, log_path: str, out_path: str, touched_buckets,
            delta_mode: str = "event_time", buckets: int = DEFAULT_BUCKETS) -> None:
    """Rebuild whole buckets of a table of months (``write_measurements``) from the whole log, for
    example after its rules changed; a stream's own table is kept by ``refresh_slices``."""
    touched = sorted(set(int(b) for b in touched_buckets))
    if not touched:
        return
    log = load_log(spark, log_path, touched)
    m = derive_measurements(log.drop("bucket"), delta_mode)
    write_measurements(m, out_path, buckets)


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, log_path: str,
                  out_path: str | None, raw_path: str | None, delta_mode: str,
                  buckets: int, rejected_path: str | None = None, hours: int = SLICE_HOURS) -> dict:
    """Body of ``foreachBatch``: S1 -> S3 -> S2, R2 for one micro-batch.  Raw rows and the
    refresh read the log segment just written.  Returns what the refresh read and wrote."""
    batch_id = int(batch_id)
    if rejected_path:
        append_rejected(batch, batch_id, rejected_path)
    taken = append_log(parse_batches(batch, batch_id, rows_before(spark, log_path, batch_id)), log_path, buckets, batch_id)
    if raw_path:
        append_raw(taken, raw_path)
    return refresh_slices(spark, taken, out_path, batch_id, delta_mode, buckets, hours) if out_path else {}


def ingest_stream(spark: SparkSession, in_path: str, log_path: str, checkpoint: str,
                  out_path: str | None = None, raw_path: str | None = None,
                  delta_mode: str = "event_time", buckets: int = DEFAULT_BUCKETS,
                  available_now: bool = True, processing_time: str | None = None,
                  rejected_path: str | None = None, max_files: int = MAX_FILES_PER_TRIGGER,
                  hours: int = SLICE_HOURS) -> StreamingQuery:
    """Start the ingest stream over JSON-Lines batch files in ``in_path``.

    ``checkpoint`` must be a shared folder (pass one under the session's
    ``spark.checkpoint.dir`` on a cluster).  ``available_now`` processes what
    is there and stops; otherwise ``processing_time`` sets the trigger, which
    takes up to ``max_files`` files.  Bodies that are rejected go to
    ``rejected_path``; readings that cannot be placed stay in the log
    (``invalid_readings`` of it gives them).
    """
    src = with_origin(spark.readStream.schema(BATCH)
                      .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
                      .option("maxFilesPerTrigger", max_files).json(in_path))

    def run(batch: DataFrame, batch_id: int) -> None:
        process_batch(spark, batch, batch_id, log_path, out_path, raw_path, delta_mode, buckets, rejected_path, hours)

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()


def events_as_batches(events: DataFrame, block_size: int = 1000, body_size: int = 3) -> DataFrame:
    """Shape derived readings as nested request bodies: per device and arrival block
    bodies (numbered ``part``) of up to ``body_size`` readings in arrival order (used
    to feed S1 and R1 from the driver's tables)."""
    r = events
    block = F.floor(F.col("arrival_seq") / F.lit(block_size))
    return (r.groupBy(block.alias("block"), "building_name", "device_external_id")
            .agg(F.sort_array(F.collect_list(F.struct(
                F.col("arrival_seq"), F.col("reading_id"),
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
                F.col("metric"), F.col("value"), F.col("unit")))).alias("rs"))
            .withColumn("part", F.explode(F.expr(f"sequence(0, (size(rs) - 1) div {int(body_size)})")))
            .select("block", "part",
                    F.struct(F.col("building_name").alias("name")).alias("building"),
                    F.struct(F.col("device_external_id").alias("external_id"),
                             F.lit(None).cast("string").alias("name")).alias("device"),
                    F.expr(f"transform(slice(rs, cast(part * {int(body_size)} + 1 as int), {int(body_size)}), "
                           "x -> named_struct('timestamp', x.timestamp, 'metric', x.metric, "
                           "'value', x.value, 'unit', x.unit))").alias("readings")))
