"""Read queries over measurements: aggregates (A1-A10), ordered reads (O1-O6),
projections (P1-P3).

Every function takes the measurement DataFrame ``m`` and returns a lazy
DataFrame.  Filters are plain predicates on stored columns, so they reach the
Parquet scan; aggregates are partial+final hash aggregates; ordered reads are
either a top-k (``TakeOrderedAndProject``) or a range-partitioned sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import (aggregate_filter, bad_filter, metric_with_legacy_bad,
                                 parse_exclude_bad, series_filter)
from ..functions.text import ENERGY_METRIC
from ..functions.time import bucket
from ..schemas import SERIES

# Fixed values that must equal the reference's: scope word, label of a building's
# total, greatest page, columns of a series row.
ALL = "all"
TOTAL_LABEL = "Total"
RECENT_MAX = 100

# The 11-column series row.
SERIES_COLUMNS = ["id", "ts", "metric", "value", "unit", "delta",
                  "is_normal", "is_reset", "is_duplicate", "is_late", "is_bad"]
FLAGS = ["is_normal", "is_reset", "is_duplicate", "is_late", "is_bad"]


def _empty(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def arrival_order(desc: bool = False) -> list[Column]:
    cols = [F.col("arrival_seq"), F.col("reading_id")]
    return [c.desc() for c in cols] if desc else [c.asc() for c in cols]


def measurement_row(m: DataFrame) -> DataFrame:
    """Typed measurement row; flags default to false, nulls kept."""
    return m.select(
        F.col("reading_id").alias("id"), "building_id", "building_name", "device_id",
        "device_external_id", "device_name", "ts", "metric", "value", "unit", "delta",
        *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in FLAGS],
        "raw_event_id", "created_at", "updated_at", "arrival_seq")


def label_expr() -> Column:
    """Device label = external id, else name, else key."""
    return F.coalesce(F.col("device_external_id"), F.col("device_name"), F.col("device_id"))


# --------------------------------------------------------------------------
# Aggregates
# --------------------------------------------------------------------------

def checked_minutes(minutes) -> int:
    """Width of a time bucket in minutes, 1..1440."""
    if not 1 <= int(minutes) <= 1440:
        raise ValueError("minutes must be within 1..1440")
    return int(minutes)


def aggregated(m: DataFrame, building: str = ALL, device: str = ALL,
               metric: str = ENERGY_METRIC, start=None, end=None, minutes: int = 60) -> DataFrame:
    """Bucketed average value and summed delta of good originals.

    ``building="all"``: one series per building (label = building name);
    a building with ``device="all"``: one series labelled ``Total``; anything
    else: empty.  Columns: ts (bucket start), label, value, delta.
    """
    minutes = checked_minutes(minutes)
    base = m.where(aggregate_filter(metric, start, end, exclude_bad=True))
    b = bucket("ts", minutes).alias("ts")
    if building == ALL:
        return (base.groupBy(b, F.col("building_id"), F.col("building_name").alias("label"))
                .agg(F.avg("value").alias("value"), F.sum(F.coalesce("delta", F.lit(0.0))).alias("delta"))
                .orderBy("ts", "building_id")
                .select("ts", "label", "value", "delta", "building_id"))
    out = (base.where(F.col("building_id") == building)
           .groupBy(b)
           .agg(F.avg("value").alias("value"), F.sum(F.coalesce("delta", F.lit(0.0))).alias("delta"))
           .select("ts", F.lit(TOTAL_LABEL).alias("label"), "value", "delta",
                   F.lit(building).alias("building_id"))
           .orderBy("ts"))
    return out if device == ALL else _empty(out)


def bad_points(m: DataFrame, building: str = ALL, metric: str = ENERGY_METRIC,
               start=None, end=None, minutes: int = 60) -> DataFrame:
    """A3: bucketed bad originals per building (F5, F9, F6); empty unless
    ``building == "all"``.  ``minutes`` 1..1440, as in ``aggregated``."""
    minutes = checked_minutes(minutes)
    out = (m.where(bad_filter(metric, start, end))
           .groupBy(bucket("ts", minutes).alias("ts"), F.col("building_id"),
                    F.col("building_name").alias("label"))
           .agg(F.avg("value").alias("value"), F.sum(F.coalesce("delta", F.lit(0.0))).alias("delta"))
           .orderBy("ts", "building_id", "label")
           .select("ts", "label", "value", "delta", "building_id"))
    return out if building == ALL else _empty(out)


def sum_deltas(m: DataFrame, building: str = ALL, device: str = ALL,
               metric: str = ENERGY_METRIC, start=None, end=None) -> DataFrame:
    """One row ``sum_delta`` = coalesce(sum(delta), 0) over good
    originals.  ``all`` building wins over device; a device total ignores the
    building argument."""
    cond = aggregate_filter(metric, start, end, exclude_bad=True)
    if building == ALL:
        pass
    elif device == ALL:
        cond = cond & (F.col("building_id") == building)
    else:
        cond = cond & (F.col("device_id") == device)
    return m.where(cond).agg(F.coalesce(F.sum("delta"), F.lit(0.0)).alias("sum_delta"))


def max_ts(m: DataFrame) -> DataFrame:
    """Latest ts of good originals per series (null when it has none)."""
    good = ~F.col("is_bad") & ~F.col("is_duplicate")
    return m.groupBy(*SERIES).agg(F.max(F.when(good, F.col("ts"))).alias("max_ts"))


def buildings(m: DataFrame) -> DataFrame:
    """Distinct (id, name), by name."""
    return (m.select(F.col("building_id").alias("id"), F.col("building_name").alias("name"))
            .distinct().orderBy("name", "id"))


def devices(m: DataFrame, building: str) -> DataFrame:
    """A10: distinct devices of one building, by external id."""
    return (m.where(F.col("building_id") == building)
            .select(F.col("device_id").alias("id"), "building_id",
                    F.col("device_external_id").alias("external_id"), F.col("device_name").alias("name"))
            .distinct().orderBy("external_id", "name"))


# --------------------------------------------------------------------------
# Ordered reads
# --------------------------------------------------------------------------

def recent_filter(device: str, metric: str = ENERGY_METRIC, exclude_bad=True):
    """F1 with F3 or F4 and F7, as ``recent`` takes them."""
    excl = parse_exclude_bad(exclude_bad)
    cond = (F.col("device_id") == device) & metric_with_legacy_bad(metric, include_bad=not excl)
    return cond & ~F.col("is_bad") if excl else cond


def recent(m: DataFrame, device: str, metric: str = ENERGY_METRIC, limit: int = 20,
           offset: int = 0, exclude_bad=True) -> DataFrame:
    """O1: newest readings of a device, duplicates kept; ts desc, arrival asc.

    ``limit`` 1..100, ``offset`` >= 0 -- the page size is the feature here.
    """
    limit, offset = int(limit), int(offset)
    if not 1 <= limit <= RECENT_MAX or offset < 0:
        raise ValueError("limit must be 1..100 and offset >= 0")
    rows = (measurement_row(m.where(recent_filter(device, metric, exclude_bad)))
            .orderBy(F.col("ts").desc(), *arrival_order()))
    if offset:
        rows = rows.offset(offset)
    return rows.limit(limit).select(
        "id", "ts", "metric", "value", "unit", "delta", *FLAGS,
        "raw_event_id", "created_at", "updated_at", "arrival_seq")


def series(m: DataFrame, device: str, metric: str = ENERGY_METRIC, start=None, end=None,
           exclude_bad=True) -> DataFrame:
    """One device's series (F11), ts ascending."""
    return (m.where(series_filter(metric, device=device, start=start, end=end, exclude_bad=exclude_bad))
            .orderBy("ts", *arrival_order())
            .select(F.col("reading_id").alias("id"), *SERIES_COLUMNS[1:], "arrival_seq"))


def building_series(m: DataFrame, building: str, metric: str = ENERGY_METRIC, start=None,
                    end=None, exclude_bad=True) -> DataFrame:
    """Every device of a building, label per device; device, ts, id asc."""
    return (m.where(series_filter(metric, building=building, start=start, end=end, exclude_bad=exclude_bad))
            .orderBy("device_id", "ts", *arrival_order())
            .select("ts", "metric", "value", "unit", "delta", *FLAGS, "device_id",
                    label_expr().alias("label"), F.col("reading_id").alias("id"), "arrival_seq"))


def all_measurements(m: DataFrame) -> DataFrame:
    """Every row, newest first (range-partitioned global sort)."""
    return measurement_row(m).orderBy(F.col("ts").desc(), *arrival_order())


def paged(rows: DataFrame, size: int = 5, order: list | None = None) -> DataFrame:
    """Page number per row of a bounded list (<= 100 rows, e.g. ``recent``),
    plus the page count (at least 1)."""
    from pyspark.sql import Window
    order = order or [F.col("ts").desc(), *(["arrival_seq"] if "arrival_seq" in rows.columns else []), F.col("id").asc()]
    w = Window.orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return (rows.withColumn("_rn", F.row_number().over(w))
            .withColumn("page", F.floor((F.col("_rn") - 1) / size).cast("long"))
            .withColumn("pages", F.greatest(F.lit(1), F.ceil(n / size)).cast("long"))
            .drop("_rn"))


def latest_per_series(m: DataFrame) -> DataFrame:
    """The newest reading of every series (ts, then arrival, latest).

    A ``max(struct)`` aggregate -- partial+final, so a hot series is combined
    map side instead of being sorted in one task.
    """
    row = F.struct(F.col("ts"), F.col("arrival_seq"), F.col("reading_id"), F.col("value"),
                   F.col("unit"), F.col("delta"), F.col("building_id"), F.col("device_external_id"),
                   *[F.col(f) for f in FLAGS])
    return (m.groupBy(*SERIES).agg(F.max(row).alias("r"))
            .select(*SERIES, "r.*"))
