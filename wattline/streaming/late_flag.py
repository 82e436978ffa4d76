"""The late flag with state per series (R4), for consumers that cannot wait for a refresh.

A reading is late when a good original with a later time arrived before it.  For this a
series needs little state: the running maximum over its good originals, and the times of
bad originals above that maximum -- a good reading at such a time is a duplicate and
does not raise it.  Times below the maximum never matter again, so the state does not
grow with the history; it is bounded by the bad originals that run ahead of the good ones.

The flag equals that of the derivation (W1, W2).  Readings of one micro-batch are taken in
arrival order; the source must hand over micro-batches in arrival order, as the segments
of the log do.  Duplicates and deltas need stored readings: those come from the refresh.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.measure import normalize, placeable
from ..schemas import LOG, SERIES

SHARDS = 1024  # of the series; fixed for a checkpoint
FLAGS = "device_id string, metric string, reading_id long, is_late boolean, kept long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flagged(rows, high: int | None, ahead: set[int]):
    """Late flags of one series' readings (time, bad) in arrival order, the state after them
    and how many times it kept after each."""
    late, kept = [], []
    for at, bad in rows:
        late.append(high is not None and at < high)
        if high is None or at > high:
            if bad:
                ahead.add(at)
            elif at not in ahead:
                high = at
                ahead = {x for x in ahead if x > at}
        kept.append(len(ahead))
    return late, high, ahead, kept


class LateFlag(StatefulProcessor):
    """One shard of series at a time: a call and its data frames cost more than the few rows that a
    series has in a micro-batch.  State is kept per series, in a map; only series with rows are read."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.series = handle.getMapState("series", "device_id string, metric string", "high long, ahead array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One shard of one micro-batch.
        mine = pd.concat(list(rows)).sort_values([*SERIES, "arrival_seq", "reading_id"], ignore_index=True)
        first = (mine[SERIES] != mine[SERIES].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        devices, metrics, at, bad = (mine[c].tolist() for c in (*SERIES, "at", "is_bad"))
        late, kept = [], []
        for start, end in zip(first, [*first[1:], len(mine)]):
            name = (devices[start], metrics[start])
            stored = self.series.getValue(name)
            high, before = (stored[0], set(stored[1])) if stored else (None, set())
            flags, top, after, counts = flagged(zip(at[start:end], bad[start:end]), high, set(before))
            if top != high or after != before:
                self.series.updateValue(name, (top, sorted(after)))
            late += flags
            kept += counts
        yield pd.DataFrame({"device_id": devices, "metric": metrics, "reading_id": mine["reading_id"].to_numpy(), "is_late": late, "kept": kept})

    def close(self) -> None:
        pass


def late_flags(readings: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A stream of readings (``READINGS`` columns) to device_id, metric, reading_id, is_late and
    ``kept``, the bad times its series' state held after it.  Needs the RocksDB state store."""
    n = normalize(readings)
    n = n.where(placeable(n)).select(F.pmod(F.xxhash64(*SERIES), F.lit(shards)).alias("shard"), *SERIES, "arrival_seq", "reading_id",
                                     F.unix_micros("ts").alias("at"), "is_bad")
    return n.groupBy("shard").transformWithStateInPandas(LateFlag(), FLAGS, "Append", "None")


def late_flag_stream(spark: SparkSession, log_path: str, out_path: str, checkpoint: str, available_now: bool = True,
                     processing_time: str | None = None) -> StreamingQuery:
    """Follow the log's newest segments (``append_log``) and append flags to ``out_path``.  A
    follower must not fall behind by more than the segments that wait for their merge."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        flags = late_flags(spark.readStream.schema(LOG).parquet(f"{log_path.rstrip('/')}/level-0/*"))
        w = flags.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
        return w.start()
    finally:
        spark.conf.set(_PROVIDER, before)
