"""Readings derived from the driver's tables.

The test tables hold no meters, so readings are derived from ``events`` with
one projection that Spark and the SQL oracle both express (FIXTURES.md §3):
buildings from ``user_id % 5``, one meter per user, hourly timestamps, energy in
kWh / Wh / an unknown unit by event type, and every 13th event arriving 900
positions late.  Every flag and both delta modes are exercised, and the
derived log grows with the ``events`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the derivation (shared with the SQL oracle).
BUILDINGS = 5
LATE_EVERY = 13
LATE_BY = 900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat readings (``schemas.READINGS`` columns) from ``events``."""
    ev = table(spark, sf_dir, "events")
    uid = F.col("user_id").cast("string")
    return ev.select(
        F.col("event_id").alias("reading_id"),
        (F.col("event_id") + F.when(F.col("event_id") % LATE_EVERY == 0, F.lit(LATE_BY)).otherwise(F.lit(0)))
        .cast("long").alias("arrival_seq"),
        F.concat(F.lit("Building "), (F.col("user_id") % BUILDINGS).cast("string")).alias("building_name"),
        F.concat(F.lit("meter-"), uid).alias("device_external_id"),
        F.lit(None).cast("string").alias("device_name"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
        F.lit("energy").alias("metric"),
        F.col("value").cast("double").alias("value"),
        F.when(F.col("event_type") == "error", F.lit("kals"))
         .when(F.col("event_type") == "view", F.lit("Wh"))
         .otherwise(F.lit("kWh")).alias("unit"),
        F.lit(None).cast("string").alias("dedupe_key"),
        F.col("props").alias("raw_payload"),
        F.col("ts").cast("timestamp").alias("ingest_time"),
    )
