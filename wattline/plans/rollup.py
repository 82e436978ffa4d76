"""Reads of a stream's stored table: bucketed aggregates and totals (A1-A7) from its rollup, and
the newest page of a device (O1).

A stream's table keeps sums and counts by quarter of an hour beside its rows, written anew
for the parts that a refresh touches and switched with them, so late repairs are in both
or in neither.  A read sums the quarters that lie whole inside the range; what a range
cuts off at its ends is summed from the rows of these ends.  Buckets that are no multiple
of a quarter come from the rows.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ENERGY_METRIC, LEGACY_ENERGY_METRIC
from ..functions.time import bucket
from ..schemas import MEASUREMENT_COLUMNS
from ..streaming.generations import ROLLUP_MINUTES, current, load_slices, rolled_up
from . import queries as q

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_QUARTER = ROLLUP_MINUTES * 60_000_000


def _micros(t: dt.datetime) -> int:
    t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return (t - _EPOCH) // dt.timedelta(microseconds=1)


def _time(micros: int) -> dt.datetime:
    return (_EPOCH + dt.timedelta(microseconds=micros)).replace(tzinfo=None)


def quarters(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """The rollup of a range, both ends inclusive (UTC); its cut ends from rows."""
    store = current(spark, path)
    low = None if start is None else -(-_micros(start) // _QUARTER) * _QUARTER
    high = None if end is None else (_micros(end) + 1) // _QUARTER * _QUARTER  # exclusive
    if low is not None and high is not None and high <= low:
        return _ends(load_slices(spark, path, start=start, end=end))
    whole, ends = store.rollup(store.parts_of(start=start, end=end)), []
    if low is not None:
        whole = whole.where(F.unix_micros("ts") >= low)
        if low > _micros(start):
            ends.append(_ends(load_slices(spark, path, start=start, end=_time(low - 1))))
    if high is not None:
        whole = whole.where(F.unix_micros("ts") < high)
        if high <= _micros(end):
            ends.append(_ends(load_slices(spark, path, start=_time(high), end=end)))
    return reduce(DataFrame.unionByName, ends, whole)


def _ends(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return rolled_up(rows.withColumn("bucket", none).withColumn("slice", none))


def _summed(rows: DataFrame, minutes: int, label: Column, *by: str) -> DataFrame:
    return (rows.groupBy(bucket("ts", minutes).alias("ts"), *by)
            .agg((F.sum("sum_value") / F.sum("n")).alias("value"), F.sum("sum_delta").alias("delta"))
            .select("ts", label.alias("label"), "value", "delta", *[c for c in by if c == "building_id"]))


def _good(metric: str) -> Column:
    return ~F.col("is_bad") & (F.col("metric") == metric)


def aggregated(spark: SparkSession, path: str, building: str = q.ALL, device: str = q.ALL, metric: str = ENERGY_METRIC,
               start=None, end=None, minutes: int = 60) -> DataFrame:
    """A1/A2/A7 as ``queries.aggregated``."""
    minutes = q.checked_minutes(minutes)
    if minutes % ROLLUP_MINUTES:
        return q.aggregated(load_slices(spark, path, start=start, end=end), building, device, metric, start, end, minutes)
    rows = quarters(spark, path, start, end).where(_good(metric))
    if building == q.ALL:
        return _summed(rows, minutes, F.col("building_name"), "building_id", "building_name").orderBy("ts", "building_id")
    out = (_summed(rows.where(F.col("building_id") == building), minutes, F.lit(q.TOTAL_LABEL))
           .withColumn("building_id", F.lit(building)).orderBy("ts"))
    return out if device == q.ALL else out.limit(0)


def bad_points(spark: SparkSession, path: str, building: str = q.ALL, metric: str = ENERGY_METRIC, start=None, end=None,
               minutes: int = 60) -> DataFrame:
    """A3 as ``queries.bad_points``."""
    minutes = q.checked_minutes(minutes)
    if minutes % ROLLUP_MINUTES:
        return q.bad_points(load_slices(spark, path, start=start, end=end), building, metric, start, end, minutes)
    rows = quarters(spark, path, start, end).where(F.col("is_bad") & F.col("metric").isin(metric, LEGACY_ENERGY_METRIC))
    out = _summed(rows, minutes, F.col("building_name"), "building_id", "building_name").orderBy("ts", "building_id", "label")
    return out if building == q.ALL else out.limit(0)


def sum_deltas(spark: SparkSession, path: str, building: str = q.ALL, device: str = q.ALL, metric: str = ENERGY_METRIC,
               start=None, end=None) -> DataFrame:
    """A4/A5/A6/A7 as ``queries.sum_deltas``."""
    rows = quarters(spark, path, start, end).where(_good(metric))
    if building != q.ALL:
        rows = rows.where(F.col("building_id") == building) if device == q.ALL else rows.where(F.col("device_id") == device)
    return rows.agg(F.coalesce(F.sum("sum_delta"), F.lit(0.0)).alias("sum_delta"))


def recent(spark: SparkSession, path: str, device: str, metric: str = ENERGY_METRIC, limit: int = 20, offset: int = 0,
           exclude_bad=True) -> DataFrame:
    """O1 as ``queries.recent``: the device's slices are opened from the newest one back, one, two,
    four, ... more at a time, until they fill the page."""
    store = current(spark, path)
    names = sorted({metric, LEGACY_ENERGY_METRIC} if metric == ENERGY_METRIC else {metric})
    parts = store.parts_of(device, names)
    slices, taken, step = sorted({s for _, s in parts}, reverse=True), 0, 1
    while True:
        taken += step
        rows = store.rows([p for p in parts if p[1] in slices[:taken]]).select(*MEASUREMENT_COLUMNS)
        if taken >= len(slices) or rows.where(q.recent_filter(device, metric, exclude_bad)).limit(offset + limit).count() >= offset + limit:
            return q.recent(rows, device, metric, limit, offset, exclude_bad)
        step *= 2
