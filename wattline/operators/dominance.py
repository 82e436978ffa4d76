"""Exact two-dimensional "dominance" lookup without emitting pairs.

For every query row q of a series, find the candidate row c of the same series
with the greatest ``(ts, arrival)`` such that ``ts_c < ts_q`` *and*
``arrival_c < arrival_q`` -- the reading a sequential loop would have seen as
"previous good reading" when q was inserted (W4 at insert time).

A range join would emit every (query, earlier candidate) pair.  Instead the
arrival rank ``y`` (dense per series) is split into binary levels: at level
``L`` rows share the block ``y >> (L+1)``; candidates with bit ``L`` = 0 serve
queries with bit ``L`` = 1 of the same block.  Over all levels those blocks
partition exactly the candidates that arrived before the query, and inside a
block only the ``ts`` condition is left -- a 1-D running max, computed with the
skew-safe ``sliced_scan``.  Cost: ``O(n log n_series)`` rows, one shuffle for the
scan, one aggregate to pick the best level per query.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Scan, sliced_scan


# Arrival blocks and the slices of a level are sparse where arrivals are: their carry is a tree.
LEVELS = 2


def series_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                slice_bits: int, extra: Sequence[Scan] = ()) -> DataFrame:
    """Add ``y`` (0-based rank in ``order`` within ``keys``) and ``y_total``
    (rows per key), plus any ``extra`` running aggregates over the same
    arrival order.  ``order[0]`` must be a long; slices are blocks of
    ``2**slice_bits`` consecutive values of it, so no task sees a whole series."""
    sliced = df.withColumn("_aslice", F.floor(F.col(order[0]) / F.lit(2 ** slice_bits)))
    out = sliced_scan(sliced, keys, list(order), "_aslice",
                      [Scan("y", F.lit(1).cast("long"), "sum", "before"), *extra],
                      frame="rows", totals=["y"], levels=LEVELS)
    return out.drop("_aslice")


def dominance_lookup(df: DataFrame, keys: Sequence[str], slice_seconds: int,
                     candidate: Column, query: Column, payload: Column) -> DataFrame:
    """Return ``keys, y, found`` for the query rows that have an answer, where
    ``found`` is ``struct(tmic, y, payload)`` of the best candidate.

    ``df`` must carry ``ts``, ``y`` and ``y_total`` (see ``series_rank``).
    """
    keys = list(keys)
    d = (df.select(*keys, "y", "y_total",
                   F.unix_micros("ts").alias("tmic"),
                   candidate.alias("_is_c"), query.alias("_is_q"), payload.alias("_pl"))
         .withColumn("_H", F.length(F.bin(F.greatest(F.col("y_total") - 1, F.lit(1))))))
    queries = (d.where("_is_q")
               .select(*keys, "y", "tmic",
                       F.explode(F.expr("filter(sequence(0, _H - 1), l -> shiftright(y, l) & 1 = 1)")).alias("L"))
               .withColumn("blk", F.expr("shiftright(y, L + 1)")))
    # A query's answer at a level depends only on (key, level, block, ts), so
    # copies at one timestamp -- a hot group -- are asked once: distinct probes
    # (partial+final aggregate, combined map side), answers joined back.
    probes = queries.select(*keys, "L", "blk", "tmic").distinct()
    # A candidate is needed only in the blocks that some query asks, so the
    # (level, block) pairs of a candidate are cut down to those before the scan:
    # a semi-join against the distinct blocks, which AQE broadcasts while they
    # are small and splits for a hot block otherwise.  A late reading near the end
    # of a series so takes every earlier candidate once, not once per level.
    asked = probes.select(*keys, "L", "blk").distinct()
    cands = (d.where("_is_c")
             .select(*keys, "y", "tmic",
                     F.explode(F.expr("filter(sequence(0, _H - 1), l -> shiftright(y, l) & 1 = 0)")).alias("L"),
                     F.struct("tmic", "y", F.col("_pl").alias("payload")).alias("_contrib"),
                     F.lit(False).alias("_q"))
             .withColumn("blk", F.expr("shiftright(y, L + 1)"))
             .join(asked, on=keys + ["L", "blk"], how="left_semi"))
    u = (cands.unionByName(probes.withColumn("_q", F.lit(True)), allowMissingColumns=True)
         .withColumn("_tslice", F.floor(F.col("tmic") / F.lit(slice_seconds * 1_000_000))))
    scanned = sliced_scan(u, keys + ["L", "blk"], "tmic", "_tslice",
                          [Scan("_ans", F.col("_contrib"), "max", "before")], levels=LEVELS)
    answers = scanned.where(F.col("_q") & F.col("_ans").isNotNull()).select(*keys, "L", "blk", "tmic", "_ans")
    return (queries.join(answers, on=keys + ["L", "blk", "tmic"], how="inner")
            .groupBy(*keys, "y").agg(F.max("_ans").alias("found")))
