"""Explicit schemas: nested ingest batches (S1), flat readings and measurements."""

from __future__ import annotations

from pyspark.sql import types as T

READING = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("dedupe_key", T.StringType()),
    # Any JSON object; read as its JSON text.
    T.StructField("raw_payload", T.StringType()),
])

BATCH = T.StructType([
    T.StructField("building", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("device", T.StructType([
        T.StructField("external_id", T.StringType()),
        T.StructField("name", T.StringType()),
    ])),
    T.StructField("readings", T.ArrayType(READING)),
    T.StructField("_corrupt_record", T.StringType()),
])

# Flat readings: the input of ``derive_measurements``.  ``arrival_seq`` with
# ``reading_id`` as tie-break is the arrival order.
READINGS = T.StructType([
    T.StructField("reading_id", T.LongType(), False),
    T.StructField("arrival_seq", T.LongType(), False),
    T.StructField("building_name", T.StringType()),
    T.StructField("device_external_id", T.StringType()),
    T.StructField("device_name", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("dedupe_key", T.StringType()),
    T.StructField("raw_payload", T.StringType()),
    T.StructField("ingest_time", T.TimestampType()),
])

# The reading log (S3): readings with their partition columns.
LOG = T.StructType([*READINGS, T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.LongType())])

MEASUREMENT = T.StructType([
    T.StructField("arrival_seq", T.LongType()),
    T.StructField("reading_id", T.LongType()),
    T.StructField("building_id", T.StringType()),
    T.StructField("building_name", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("device_external_id", T.StringType()),
    T.StructField("device_name", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("is_normal", T.BooleanType()),
    T.StructField("is_reset", T.BooleanType()),
    T.StructField("is_duplicate", T.BooleanType()),
    T.StructField("is_late", T.BooleanType()),
    T.StructField("is_bad", T.BooleanType()),
    T.StructField("raw_event_id", T.LongType()),
    T.StructField("delta", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])
MEASUREMENT_COLUMNS = MEASUREMENT.names

SERIES = ["device_id", "metric"]
