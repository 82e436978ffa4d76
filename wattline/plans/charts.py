"""Chart data products (H1-H4): compositions of series reads, rolling windows,
pivot and overlay.  Everything stays a DataFrame: wide tables have the labels
that the caller names, otherwise the rows stay long.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import parse_exclude_bad
from ..functions.text import ENERGY_METRIC
from ..functions.time import bucket, time_label
from ..operators.pivot import BAD_PREFIX, empty_overlay, long_table, pivot_labels
from ..operators.rolling import DEFAULT_MINUTES, mode_value, rolling, split_points
from . import queries as q


def device_chart(m: DataFrame, device: str, metric: str = ENERGY_METRIC, start=None, end=None,
                 mode: str = "raw", rolling_minutes=DEFAULT_MINUTES, show_bad: bool = False) -> DataFrame:
    """H1: one device's series -> bad rows dropped unless shown (shown bad rows
    enter the rolling window) -> mode -> main/bad/late split."""
    rows = q.series(m, device, metric, start, end, exclude_bad=not show_bad)
    if not show_bad:
        rows = rows.where(~F.col("is_bad"))
    rolled = rolling(rows.withColumn("_one", F.lit(0)), mode, rolling_minutes, by=["_one"],
                     order=["arrival_seq", "id"]).drop("_one")
    return (split_points(rolled, mode)
            .withColumn("tsLabel", time_label("ts"))
            .orderBy("ts", "arrival_seq", "id"))


def building_chart(m: DataFrame, building: str, metric: str = ENERGY_METRIC, start=None, end=None,
                   mode: str = "raw", rolling_minutes=DEFAULT_MINUTES, show_bad: bool = False,
                   labels: Sequence[str] | None = None) -> DataFrame:
    """H2: every device of a building -> per-label rolling -> pivot.
    Long rows (ts, tsLabel, label, value) for any number of devices; one column
    per label when the caller names ``labels`` (no overlay for a single building:
    every ``bad_<label>`` is null)."""
    rows = q.building_series(m, building, metric, start, end, exclude_bad=not show_bad)
    if not show_bad:
        rows = rows.where(~F.col("is_bad"))
    rolled = rolling(rows, mode, rolling_minutes, by=["label"], order=["device_id", "arrival_seq", "id"])
    plotted = rolled.withColumn("value", mode_value(mode))
    if labels is None:
        return long_table(plotted, "value", order=["device_id", "arrival_seq", "id"]).withColumn("tsLabel", time_label("ts"))
    wide = pivot_labels(plotted, labels, "value", order=["device_id", "arrival_seq", "id"])
    return empty_overlay(wide.withColumn("tsLabel", time_label("ts")), labels).orderBy("ts")


def all_buildings_chart(m: DataFrame, metric: str = ENERGY_METRIC, start=None, end=None,
                        minutes: int = 60, rolling_minutes=DEFAULT_MINUTES, show_bad: bool = False,
                        labels: Sequence[str] | None = None) -> DataFrame:
    """H3: buckets per building (A1) -> always the rolling average of the bucket
    average -> pivot -> bad overlay (A3 via J4) when bad points are shown."""
    if show_bad and labels is not None:
        return _buildings_with_bad(m, metric, start, end, minutes, rolling_minutes, labels)
    agg = q.aggregated(m, q.ALL, q.ALL, metric, start, end, minutes)
    rolled = rolling(agg, "rolling_avg", rolling_minutes, by=["label"], order=["building_id"])
    if labels is None:
        out = long_table(rolled, "value", order=["building_id"]).withColumn("tsLabel", time_label("ts"))
        if not show_bad:
            return out
        bad = long_table(q.bad_points(m, q.ALL, metric, start, end, minutes).withColumn("value", F.coalesce("value", F.lit(0.0))),
                         "value", order=["building_id", "label"]).withColumnRenamed("value", "bad_value")
        return out.join(bad, ["ts", "label"], "left").orderBy("ts", "label")
    wide = pivot_labels(rolled, labels, "value", order=["building_id"]).withColumn("tsLabel", time_label("ts"))
    return empty_overlay(wide, labels).orderBy("ts")


def _buildings_with_bad(m: DataFrame, metric: str, start, end, minutes: int, rolling_minutes,
                        labels: Sequence[str]) -> DataFrame:
    """H3 with shown bad points: one aggregate gives the good and the bad average of
    every (bucket, building), one more lays out the named labels."""
    good = q.aggregate_filter(metric, start, end, exclude_bad=True)
    bad = q.bad_filter(metric, start, end)
    points = (m.where(good | bad)
              .groupBy(bucket("ts", q.checked_minutes(minutes)).alias("ts"), "building_id", F.col("building_name").alias("label"))
              .agg(F.avg(F.when(good, F.col("value"))).alias("value"), F.max(good).alias("_good"),
                   F.avg(F.when(bad, F.col("value"))).alias("_bad_value"), F.max(bad).alias("_bad")))
    # A bucket without good readings adds nothing to the rolling average.
    rolled = rolling(points, "rolling_avg", rolling_minutes, by=["label"], order=["building_id"])
    cells = []
    for prefix, here, value in (("", "_good", F.col("value")), (BAD_PREFIX, "_bad", F.coalesce("_bad_value", F.lit(0.0)))):
        cells += [F.max_by(value, F.when(F.col(here) & (F.col("label") == lab), F.col("building_id"))).alias(prefix + lab)
                  for lab in sorted(labels)]
    out = rolled.groupBy("ts").agg(F.max("_good").alias("_any_good"), *cells).where("_any_good").drop("_any_good")
    return out.withColumn("tsLabel", time_label("ts")).orderBy("ts")


def series_per_building(m: DataFrame, metric: str = ENERGY_METRIC, start=None, end=None,
                        minutes: int = 60, mode: str = "raw") -> DataFrame:
    """H4: one ts-sorted series per building of value (or delta), null -> 0."""
    key = "delta" if mode == "delta" else "value"
    agg = q.aggregated(m, q.ALL, q.ALL, metric, start, end, minutes)
    return (agg.select(F.col("label").alias("building"), "ts", time_label("ts").alias("tsLabel"),
                       F.coalesce(F.col(key), F.lit(0.0)).alias(key))
               .orderBy("building", "ts"))


def chart(m: DataFrame, building: str = q.ALL, device: str = q.ALL, **kw) -> DataFrame:
    """Pick the chart the way a viewer does: all buildings -> H3; a building
    with all devices -> H2; one device -> H1."""
    show_bad = not parse_exclude_bad(kw.pop("exclude_bad", True))
    if building == q.ALL:
        kw.pop("mode", None)
        return all_buildings_chart(m, show_bad=show_bad, **kw)
    if device == q.ALL:
        kw.pop("minutes", None)
        return building_chart(m, building, show_bad=show_bad, **kw)
    kw.pop("minutes", None)
    kw.pop("labels", None)
    return device_chart(m, device, show_bad=show_bad, **kw)
