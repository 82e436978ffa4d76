"""Measurement derivation (C2-C8 applied, W1-W7, W10-W12).

The reference runs a sequential loop that reads table state before each
insert.  Here every output is a function of the whole append-only reading log
and its arrival order, computed set-based:

* readings are collapsed to one row per ``(series, ts)`` ("time groups") with a
  partial+final hash aggregate over one decimal arrival key, so a hot group of
  copies is combined map side and never lands in one task;
* running aggregates over event time use ``sliced_scan`` (hour slices with a
  carried-in summary), so a hot series is split across many tasks;
* the per-group results are joined back onto the readings (AQE splits a hot
  join key; the group side has one row per key).

``is_late`` (W1/W2) is "an earlier arrival among good originals has a later
timestamp", rewritten as a *suffix minimum* of arrival order over event time,
so both flags and the event-time delta share one partitioning.

Two delta definitions:

* ``event_time`` (default): value minus the previous good original by event
  time, clamped at 0; null without a predecessor and for duplicates.
* ``arrival``: exact parity with the sequential loop including its repair of the
  successor of every late reading (good or bad).  Computed from interval rules
  (the last "writer" of each good original), an arrival-ordered prefix maximum
  that answers every reading not preceded by a later-ts arrival, and an exact
  two-dimensional dominance lookup (``dominance.py``) for the rest.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import with_keys
from ..functions.text import (canonical_metric, canonical_unit, canonical_value,
                              is_bad_flag, is_normal_flag, normalize_key)
from ..schemas import SERIES
from .dominance import dominance_lookup, series_rank
from ..session import materialize
from .scan import Scan, sliced_scan

DEFAULT_SLICE_SECONDS = 3600
DEFAULT_ARRIVAL_SLICE_BITS = 20  # 2^20 arrival positions per slice: ~sqrt of a 2^40 arrival range


def normalize(readings: DataFrame) -> DataFrame:
    """Canonical metric/unit/value, is_normal, is_bad and stable keys.

    Keeps every input column; ``metric``, ``unit`` and ``value`` are replaced
    by their canonical forms.
    """
    cols = set(readings.columns)
    df = readings
    if "device_name" not in cols:
        df = df.withColumn("device_name", F.lit(None).cast("string"))
    if "ingest_time" not in cols:
        df = df.withColumn("ingest_time", F.lit(None).cast("timestamp"))
    df = df.withColumn("_mk", normalize_key("metric")).withColumn("_uk", normalize_key("unit"))
    df = with_keys(df)
    return df.select(
        *[c for c in df.columns if c not in ("metric", "unit", "value", "_mk", "_uk")],
        canonical_metric("_mk", keyed=True).alias("metric"),
        canonical_unit("_mk", "_uk", keyed=True, raw_unit="unit").alias("unit"),
        canonical_value("_mk", "_uk", "value", keyed=True).alias("value"),
        is_normal_flag("_mk", "_uk", keyed=True).alias("is_normal"),
        is_bad_flag("_mk", "_uk", keyed=True).alias("is_bad"),
    )


def arrival_key(arrival_seq: str, reading_id: str):
    """Arrival order ``(arrival_seq, reading_id)`` as one ``decimal(38,0)``:
    ``arrival_seq * 10^19 + reading_id`` orders exactly like the pair for any
    long ``arrival_seq`` and non-negative ``reading_id``.  A single decimal
    keeps ``min``/``min_by`` hash-aggregatable (a struct key forces Spark's
    sort-based aggregation on the largest aggregate of the pipeline)."""
    shift = F.lit("10000000000000000000").cast("decimal(20,0)")
    return (F.col(arrival_seq).cast("decimal(38,0)") * shift
            + F.col(reading_id).cast("decimal(38,0)")).cast("decimal(38,0)")


def placeable(n: DataFrame):
    """A reading can be placed in a series only with a timestamp, a metric, a
    value, a device id and a building; ``invalid_readings`` gives the rest."""
    return (F.col("ts").isNotNull() & F.col("metric").isNotNull() & F.col("value").isNotNull()
            & F.col("device_external_id").isNotNull() & F.col("building_name").isNotNull())


def invalid_readings(readings: DataFrame) -> DataFrame:
    """Readings that ``derive_measurements`` cannot place (null timestamp --
    e.g. text that did not parse --, metric, device id, building or value), with a reason."""
    n = normalize(readings)
    reason = (F.when(F.col("ts").isNull(), F.lit("timestamp"))
              .when(F.col("metric").isNull(), F.lit("metric"))
              .when(F.col("device_external_id").isNull(), F.lit("device"))
              .when(F.col("building_name").isNull(), F.lit("building"))
              .otherwise(F.lit("value")))
    return n.where(~placeable(n)).withColumn("reason", reason)


def _time_groups(n: DataFrame, slice_seconds: int, arrival: bool) -> DataFrame:
    """One row per (series, ts): the first arrival (the original) and the
    running aggregates over event time that every reading of the group shares."""
    tg = (n.groupBy(*SERIES, "ts")
          .agg(F.min("ord").alias("o_ord"), F.min_by("value", "ord").alias("o_value"),
               F.min_by("is_bad", "ord").alias("o_bad"))
          .select(*SERIES, "ts", "o_ord", "o_value", (~F.col("o_bad")).alias("o_good"))
          .withColumn("tmic", F.unix_micros("ts"))
          .withColumn("tslice", F.floor(F.col("tmic") / F.lit(slice_seconds * 1_000_000))))
    scans = [
        # Previous good original by event time (strictly earlier ts).
        Scan("prev", F.when(F.col("o_good"), F.struct("tmic", "o_ord", "o_value")), "max", "before", ("tmic", "o_ord", "o_value")),
        # First arrival among good originals with a later ts.
        Scan("late_min", F.when(F.col("o_good"), F.col("o_ord")), "min", "after"),
    ]
    if arrival:
        # Interval number: good originals with ts <= own ts.
        scans.append(Scan("iv", F.col("o_good").cast("long"), "sum", "upto"))
    tgs = sliced_scan(tg, SERIES, "tmic", "tslice", scans)
    if not arrival:
        return tgs
    # W7 writers of a good original i (interval k = rows between its event-time
    # predecessor g and i): the last bad original of the interval if it arrived
    # after i, or g if it arrived after i -- whichever arrived last.
    bad_last = (tgs.where(~F.col("o_good"))
                .groupBy(*SERIES, F.col("iv").alias("grp"))
                .agg(F.max(F.struct(F.col("o_ord").alias("w_ord"), F.col("o_value").alias("w_value"))).alias("b")))
    tgs = (tgs.withColumn("grp", F.col("iv") - 1)
           .join(bad_last, on=SERIES + ["grp"], how="left"))
    from_bad = F.when(F.col("o_good") & (F.col("b.w_ord") > F.col("o_ord")), F.col("b"))
    from_prev = F.when(F.col("o_good") & (F.col("prev.o_ord") > F.col("o_ord")),
                       F.struct(F.col("prev.o_ord").alias("w_ord"), F.col("prev.o_value").alias("w_value")))
    return tgs.withColumn("writer", F.greatest(from_bad, from_prev)).drop("b", "grp")


def derive_measurements(readings: DataFrame, delta_mode: str = "event_time",
                        slice_seconds: int = DEFAULT_SLICE_SECONDS,
                        arrival_slice_bits: int = DEFAULT_ARRIVAL_SLICE_BITS,
                        materialize_steps: bool = True) -> DataFrame:
    """Readings -> one measurement row per reading (MEASUREMENT schema).

    Arrival mode fans one intermediate result out to several branches; with
    ``materialize_steps`` (default) it is written once under the session's
    checkpoint folder (one eager job) instead of being recomputed from the
    input by every branch.

    ``readings`` needs ``reading_id, arrival_seq, building_name,
    device_external_id, ts, metric, value, unit`` (optional ``device_name``,
    ``ingest_time``).  Arrival order is ``(arrival_seq, reading_id)``.
    Readings without timestamp, metric or value cannot be placed in a series;
    they are listed by ``invalid_readings`` instead.
    """
    n = normalize(readings)
    return derive_placed(n.where(placeable(n)), delta_mode, slice_seconds, arrival_slice_bits, materialize_steps)


def derive_placed(n: DataFrame, delta_mode: str = "event_time", slice_seconds: int = DEFAULT_SLICE_SECONDS,
                  arrival_slice_bits: int = DEFAULT_ARRIVAL_SLICE_BITS, materialize_steps: bool = True,
                  keep: Sequence[str] = (), source: str | None = None, write_step=materialize) -> DataFrame:
    """``derive_measurements`` of readings that are normalised and placeable.

    ``keep`` names further columns to hand through; ``source`` names a column for the
    arrival key of the reading that a delta was last taken against by event time (event
    mode: the previous good original; arrival mode: the writer that repaired the row).
    ``write_step`` writes the intermediate table (default: the application's folder)."""
    if delta_mode not in ("event_time", "arrival"):
        raise ValueError(f"unknown delta_mode {delta_mode!r}")
    arrival = delta_mode == "arrival"
    n = n.withColumn("ord", arrival_key("arrival_seq", "reading_id"))
    tgs = _time_groups(n, slice_seconds, arrival)
    shared = [*SERIES, "ts", "o_ord", "prev", "late_min"] + (["writer"] if arrival else [])
    rows = n
    if arrival:
        # The per-series arrival rank (for the dominance lookup) depends only
        # on the readings, so it is computed on this branch, in parallel with
        # the time groups, before the join.
        # Same pass: the greatest (ts, arrival) good reading that arrived
        # earlier.  When its ts is below the reading's own ts it *is* the
        # insert-time predecessor, so only the other readings (late ones and
        # copies) need the two-dimensional lookup.
        arrived_before = Scan("_pmax", F.when(~F.col("is_bad"), F.struct(
            F.unix_micros("ts").alias("tmic"), F.col("ord"), F.col("value"))), "max", "before")
        rows = series_rank(n, SERIES, ["arrival_seq", "reading_id"], arrival_slice_bits, [arrived_before])
    m = rows.join(tgs.select(*shared), on=SERIES + ["ts"], how="inner")
    m = (m.withColumn("is_duplicate", F.col("ord") != F.col("o_ord"))
          .withColumn("is_late", F.coalesce(F.col("late_min") < F.col("ord"), F.lit(False))))

    if not arrival:
        prev_value = F.col("prev.o_value")
        delta_raw = F.when(prev_value.isNotNull(), F.greatest(F.lit(0.0), F.col("value") - prev_value))
    else:
        # Good originals with a writer take the writer's value; every other
        # reading uses the value it saw at insert time (W4): the greatest
        # (ts, arrival) good reading with an earlier ts that arrived earlier.
        has_writer = (~F.col("is_duplicate")) & F.col("writer").isNotNull()
        easy = F.col("_pmax").isNull() | (F.col("_pmax.tmic") < F.unix_micros("ts"))
        m = m.withColumn("needs_lookup", ~has_writer & ~easy).withColumn("_easy", easy)
        if materialize_steps:
            m = write_step(m, "flags")
        found = dominance_lookup(
            m, SERIES, slice_seconds,
            candidate=~F.col("is_bad"), query=F.col("needs_lookup"),
            payload=F.col("value"))
        m = m.join(found, on=SERIES + ["y"], how="left")
        prev_value = (F.when(has_writer, F.col("writer.w_value"))
                      .when(F.col("_easy"), F.col("_pmax.value"))
                      .otherwise(F.col("found.payload")))
        delta_raw = F.when(prev_value.isNotNull(), F.greatest(F.lit(0.0), F.col("value") - prev_value))

    m = m.withColumn("_delta_raw", delta_raw)
    more = [F.col(c) for c in keep]
    if source is not None:
        taken = F.when(has_writer, F.col("writer.w_ord")) if arrival else F.col("prev.o_ord")
        more.append(taken.alias(source))
    out = m.select(
        "arrival_seq", "reading_id", "building_id", "building_name", "device_id",
        "device_external_id", "device_name", "ts", "metric", "value", "unit",
        "is_normal",
        F.coalesce(F.col("_delta_raw") == 0.0, F.lit(False)).alias("is_reset"),
        "is_duplicate", "is_late", "is_bad",
        F.col("reading_id").alias("raw_event_id"),
        F.when(~F.col("is_duplicate"), F.col("_delta_raw")).alias("delta"),
        F.col("ingest_time").alias("created_at"),
        F.when(F.col("is_late") | F.col("is_duplicate"), F.col("ingest_time")).alias("updated_at"), *more,
    )
    return out
