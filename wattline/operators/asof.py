"""Existence probe and as-of lookups of probes against the log.

As-of joins are a union of probes and log rows followed by a skew-safe running
max/min over event time (``sliced_scan``): no range join, no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SERIES
from .measure import arrival_key
from .scan import Scan, sliced_scan

SLICE_SECONDS = 3600
KEYS = SERIES + ["ts"]


def existing(batch: DataFrame, log: DataFrame) -> DataFrame:
    """Batch rows whose (device, metric, ts) is already in the log."""
    return batch.join(log.select(*KEYS), on=KEYS, how="left_semi")


def flag_existing(batch: DataFrame, log: DataFrame) -> DataFrame:
    """J1 as a flag on every batch row (log keys de-duplicated by aggregate)."""
    seen = log.groupBy(*KEYS).agg(F.lit(True).alias("exists_in_log"))
    return (batch.join(seen, on=KEYS, how="left")
                 .withColumn("exists_in_log", F.coalesce("exists_in_log", F.lit(False))))


def arrived_before(batch: DataFrame, log: DataFrame) -> DataFrame:
    """J1 for readings that are in the log themselves: batch rows (``arrival_seq``,
    ``reading_id``) whose (device, metric, ts) an earlier arrival of any quality holds.
    The log is cut to the first arrival of each key by partial aggregates."""
    first = log.groupBy(*KEYS).agg(F.min(arrival_key("arrival_seq", "reading_id")).alias("_first"))
    return batch.join(first, on=KEYS).where(F.col("_first") < arrival_key("arrival_seq", "reading_id")).drop("_first")


def _union_scan(probes: DataFrame, log: DataFrame, log_filter, side: str, how: str,
                slice_seconds: int) -> DataFrame:
    contrib = F.struct(F.unix_micros("ts").alias("tmic"), "arrival_seq", "reading_id", "value")
    ctype = log.select(contrib.alias("c")).schema["c"].dataType
    pcols = probes.columns
    lg = log.where(log_filter).select(
        *SERIES, "ts", contrib.alias("_c"), F.lit(False).alias("_probe"),
        *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in pcols if c not in KEYS])
    pr = probes.select(*SERIES, "ts", F.lit(None).cast(ctype).alias("_c"), F.lit(True).alias("_probe"),
                       *[c for c in pcols if c not in KEYS])
    u = (lg.unionByName(pr)
           .withColumn("_tmic", F.unix_micros("ts"))
           .withColumn("_slice", F.floor(F.col("_tmic") / F.lit(slice_seconds * 1_000_000))))
    out = sliced_scan(u, SERIES, "_tmic", "_slice", [Scan("_hit", F.col("_c"), how, side)])
    return (out.where("_probe")
               .select(*pcols,
                       F.timestamp_micros(F.col("_hit.tmic")).alias("match_ts"),
                       F.col("_hit.value").alias("match_value"),
                       F.col("_hit.reading_id").alias("match_id")))


def asof_backward(probes: DataFrame, log: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Per probe (device_id, metric, ts) the latest good reading strictly
    before ts; bad rows skipped, duplicates kept; equal ts -> newest arrival."""
    return _union_scan(probes, log, ~F.col("is_bad"), "before", "max", slice_seconds)


def asof_forward(probes: DataFrame, log: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Per probe the earliest good original strictly after ts (tie: id)."""
    return _union_scan(probes, log, ~F.col("is_bad") & ~F.col("is_duplicate"), "after", "min",
                       slice_seconds)
