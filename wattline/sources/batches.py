"""Nested reading batches in, append-only log and measurement tables out.

Layout (all Parquet, no table format with MERGE needed):

* ``raw``:  one row per reading (S2), partitioned by ``batch_id``;
* ``log``:  flat readings with their arrival order (S3), in levelled segments
  (``segments.py``) sorted by ``bucket`` (hash of the series key);
* ``measurements``: derived rows (W12), partitioned by ``bucket`` and month when they
  are written once, and by bucket and time slice, in generations, when a stream keeps
  them (``streaming/generations.py``).

A replayed batch replaces its own segment or generation instead of appending twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import device_key
from ..functions.filters import time_range
from ..functions.text import ENERGY_METRIC, LEGACY_ENERGY_METRIC, canonical_metric
from ..functions.time import parse_ts
from ..schemas import BATCH
from .segments import append_segment, live_segments, read_segments

DEFAULT_BUCKETS = 64
# Stored measurements are cut by month; text, so that its order is that of time.
MONTH = "yyyyMM'm'"


def series_bucket(buckets: int = DEFAULT_BUCKETS):
    """Stable bucket of the series key (device key + canonical metric)."""
    return F.pmod(F.xxhash64(device_key("device_external_id"), canonical_metric("metric")), F.lit(buckets))


def number_bodies(bodies: DataFrame) -> DataFrame:
    """Add ``_first``: how many readings all earlier bodies hold, in the order
    (``batch_id``, file, position of the body in the file).

    ``_file`` and ``_block`` (start of the input split) come from ``read_bodies``;
    a DataFrame without files is taken in the order of its partitions.  Lines of
    one split are read by one task in file order, so ``_line`` orders them.  Bodies
    are summed inside their split; only one row per split -- no more than the
    driver lists to plan the scan -- goes through the window over all splits.
    """
    b = bodies.withColumn("_line", F.monotonically_increasing_id())
    if "_file" not in b.columns:
        b = b.withColumn("_file", F.lit("")).withColumn("_block", F.spark_partition_id().cast("long"))
    b = b.withColumn("_n", F.when(F.col("readings").isNull(), 0).otherwise(F.size("readings")).cast("long"))
    split = ["batch_id", "_file", "_block"]
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*split).orderBy("_line").rowsBetween(*earlier)
    b = b.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    starts = (b.groupBy(*split).agg(F.sum("_n").alias("_t"))
              .select(*split, F.coalesce(F.sum("_t").over(Window.orderBy(*split).rowsBetween(*earlier)), F.lit(0)).alias("_start")))
    return b.join(starts, split).withColumn("_first", F.col("_start") + F.col("_inside"))


def parse_batches(batches: DataFrame, batch_id, first_id: int = 0) -> DataFrame:
    """Nested batches -> one flat reading per list entry, list order kept.

    Readings are numbered without gaps from ``first_id`` in arrival order: batch
    (``batch_id``, column or int), file name, position of the body in its file,
    position in the readings list.  The number is both ``reading_id`` and
    ``arrival_seq``, so ids are unique in any number of bodies, files and batches;
    a caller that appends passes the count of readings taken before.
    A malformed batch (``_corrupt_record``) yields no readings and is given by
    ``rejected_bodies``; timestamps that do not parse come out null so callers
    can quarantine them.  ``ingest_time`` is the file's time (``_arrived``) where
    the source has one, so a replay repeats it.  A batch without a number fails.
    """
    bid = F.lit(batch_id) if isinstance(batch_id, int) else batch_id
    bid = F.coalesce(bid.cast("long"), F.raise_error(F.lit("batch without a number")).cast("long"))
    cols = batches.columns
    bodies = number_bodies(batches.withColumn("batch_id", bid).withColumn(
        "ingest_time", F.col("_arrived") if "_arrived" in cols else F.current_timestamp())
        .withColumn("readings", F.when(F.col("_corrupt_record").isNull(), F.col("readings"))
                    if "_corrupt_record" in cols else F.col("readings")))
    flat = bodies.select("batch_id", "ingest_time", "building", "device", "_first", F.posexplode("readings").alias("pos", "r"))
    seq = F.lit(int(first_id)).cast("long") + F.col("_first") + F.col("pos")
    return flat.select(
        seq.alias("reading_id"), seq.alias("arrival_seq"), "batch_id",
        F.col("building.name").alias("building_name"),
        F.col("device.external_id").alias("device_external_id"),
        F.col("device.name").alias("device_name"),
        parse_ts(F.col("r.timestamp")).alias("ts"),
        F.col("r.metric").alias("metric"), F.col("r.value").alias("value"), F.col("r.unit").alias("unit"),
        F.col("r.dedupe_key").alias("dedupe_key"), F.col("r.raw_payload").alias("raw_payload"),
        "ingest_time",
    )


def with_origin(bodies: DataFrame) -> DataFrame:
    """Add the file's time, the file and the start of the split of every body."""
    meta = {"_arrived": "file_modification_time", "_file": "file_path", "_block": "file_block_start"}
    return bodies.select("*", *[F.col(f"_metadata.{field}").alias(name) for name, field in meta.items()])


def read_bodies(spark: SparkSession, path) -> DataFrame:
    """Request bodies of JSON Lines files (one per line, explicit schema, PERMISSIVE),
    malformed ones in ``_corrupt_record``, with their origin (``with_origin``)."""
    return with_origin(spark.read.schema(BATCH)
                       .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
                       .json(path))


def rejected_bodies(batches: DataFrame) -> DataFrame:
    """Bodies that ``parse_batches`` takes no reading from because they break the
    schema (their text as read) or have no readings list: file, body, reason."""
    broken = F.col("_corrupt_record").isNotNull()
    return (batches.where(broken | F.col("readings").isNull())
            .select(F.col("_file").alias("file"),
                    F.coalesce("_corrupt_record", F.to_json(F.struct("building", "device"))).alias("body"),
                    F.when(broken, "malformed").otherwise("no readings").alias("reason")))


def read_batches(spark: SparkSession, path: str, batch_id=None) -> DataFrame:
    """S1 over files: JSON Lines, one batch object per line, explicit schema,
    PERMISSIVE mode.  Without ``batch_id`` the batch order is the numeric
    ``batch_id=<n>`` directory of each file (partition discovery)."""
    df = read_bodies(spark, path)
    if batch_id is None:
        if "batch_id" not in df.columns:
            raise ValueError("files need batch_id=<n> directories or an explicit batch_id")
        df = df.withColumnRenamed("batch_id", "_bid")
        batch_id = F.col("_bid")
    return parse_batches(df, batch_id)


def write_batches(batches: DataFrame, path: str, batch_col: str = "block", order=("device.external_id", "part"),
                  mode: str = "overwrite") -> None:
    """Write nested batches as JSON Lines, one ``batch_id=<n>`` folder and file
    per batch number, bodies of a file in ``order``.  The number is zero-padded so
    file paths sort in batch order; partition discovery reads it back as a number."""
    (batches.withColumn("batch_id", F.lpad(F.col(batch_col).cast("string"), 12, "0")).drop(batch_col)
     .repartition("batch_id").sortWithinPartitions("batch_id", *order)
     .write.mode(mode).partitionBy("batch_id").json(path))


def raw_events(readings: DataFrame) -> DataFrame:
    """One raw row per reading (bad and duplicate ones too); payload as JSON text."""
    return readings.select(F.col("reading_id").alias("id"), "raw_payload",
                           F.col("ingest_time").alias("created_at"), "batch_id")


def append_raw(readings: DataFrame, path: str) -> None:
    """Write the raw rows of the batches in ``readings`` (idempotent per batch)."""
    (raw_events(readings).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def append_rejected(batches: DataFrame, batch_id: int, path: str) -> None:
    """Write the rejected bodies of one batch (idempotent per batch)."""
    (rejected_bodies(batches).withColumn("batch_id", F.lit(int(batch_id)).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def append_log(readings: DataFrame, path: str, buckets: int = DEFAULT_BUCKETS, batch_id: int | None = None) -> DataFrame:
    """S3: append the flat readings of one batch to the log as a segment
    (``segments.append_segment``) and return them; a replayed batch replaces its own."""
    if batch_id is None:
        batch_id = readings.agg(F.max("batch_id")).first()[0]
    return append_segment(readings.withColumn("bucket", series_bucket(buckets)), path, batch_id)


def load_log(spark: SparkSession, path: str, buckets_filter=None) -> DataFrame:
    """Scan the reading log (empty when nothing was appended): its live segments only.  Files are
    sorted by bucket, so a bucket list skips row groups."""
    df = read_segments(spark, path, live_segments(spark, path))
    if buckets_filter is not None:
        df = df.where(F.col("bucket").isin(list(buckets_filter)))
    return df


def measurement_bucket(device, metric, buckets: int = DEFAULT_BUCKETS):
    """Bucket of a stored series, from columns or from literals (then a constant)."""
    return F.pmod(F.xxhash64(device, metric), F.lit(buckets))


def load_measurements(spark: SparkSession, path: str, device: str | None = None, metric: str = ENERGY_METRIC,
                      start=None, end=None, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Scan stored measurements.  A device (with its metric) opens only its
    bucket, a time range only its months; inside the files, which are sorted by
    series and time, device, metric and range skip row groups.  The legacy metric
    name of old bad rows has its own bucket, which a device read opens as well.  A table
    that a stream keeps (``streaming.generations``) is read through its manifest."""
    from ..streaming.generations import current, load_slices
    if current(spark, path) is not None:
        return load_slices(spark, path, device, metric, start, end)
    df = spark.read.parquet(path)
    if device is not None:
        names = {metric, LEGACY_ENERGY_METRIC} if metric == ENERGY_METRIC else {metric}
        home = [measurement_bucket(F.lit(device), F.lit(name), buckets) for name in sorted(names)]
        df = df.where(F.col("bucket").isin(home) & (F.col("device_id") == device) & F.col("metric").isin(sorted(names)))
    for bound, lower in ((start, True), (end, False)):
        if bound is not None:
            month = F.date_format(F.lit(bound).cast("timestamp"), MONTH)
            df = df.where((F.col("event_month") >= month) if lower else (F.col("event_month") <= month))
    return df.where(time_range(start, end)).drop("bucket", "event_month")


def write_measurements(m: DataFrame, path: str, buckets: int = DEFAULT_BUCKETS) -> None:
    """(re)write the buckets present in ``m`` by month; other buckets are untouched.

    Range partitioning on (bucket, series, ts) -- sampled boundaries -- splits
    a hot bucket or a hot series over several tasks (a hash repartition by
    bucket would give a bucket holding a third of the rows to one task) and
    leaves files sorted by (device_id, metric, ts) for min/max skipping."""
    (m.withColumn("bucket", measurement_bucket("device_id", "metric", buckets))
     .withColumn("event_month", F.date_format("ts", MONTH))
     .repartitionByRange("bucket", "device_id", "metric", "ts")
     .sortWithinPartitions("bucket", "event_month", "device_id", "metric", "ts")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", "event_month").parquet(path))
