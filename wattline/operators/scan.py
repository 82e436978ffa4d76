"""Skew-safe ordered scans: prefix/suffix aggregates over a series.

A plain ``Window.partitionBy(series)`` puts a whole series into one task, so a
device that holds a third of all readings becomes one task.  ``sliced_scan``
splits every series into slices (for example one hour of event time, or a
block of arrival positions) and computes each running aggregate in two levels:

1. inside a slice: an ordinary window partitioned by ``(series, slice)``;
2. across slices: one summary row per ``(series, slice)`` (partial+final hash
   aggregate, so a hot slice is pre-aggregated map side), a window over the
   small summary table, and an equi-join of that carry back onto the rows.

The result equals the unsliced window because max/min/sum are associative.
Work and shuffle volume stay linear in the rows; the largest task is bounded
by the slice size, not by the series size.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPREAD = 1024  # slices in a group of the carry's tree
_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


@dataclass(frozen=True)
class Scan:
    """One running aggregate.

    name:    output column
    contrib: what a row contributes (null contributes nothing)
    how:     ``max`` | ``min`` | ``sum``
    side:    ``before`` (order strictly lower), ``after`` (strictly higher) or
             ``upto`` (lower or equal, peers included)
    fields:  for a ``max`` of structs whose first field no two contributions of a key share: the
             names of the fields.  The summary of a slice then takes them one by one, which stays a
             hash aggregate (a struct buffer would make Spark sort all rows for it).
    """

    name: str
    contrib: Column
    how: str
    side: str
    fields: tuple[str, ...] = ()


def _within_frame(part, order_cols, side: str, frame: str):
    """Growing frames only: Spark evaluates ``unboundedPreceding`` frames
    incrementally, but re-aggregates an ``unboundedFollowing`` frame for every
    row.  A suffix ("after") is therefore a prefix of the descending order."""
    if side == "after":
        w = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order_cols])
    else:
        w = Window.partitionBy(*part).orderBy(*order_cols)
    if frame == "range":
        return w.rangeBetween(Window.unboundedPreceding, 0 if side == "upto" else -1)
    return w.rowsBetween(Window.unboundedPreceding, 0 if side == "upto" else -1)


def _combine(how: str, within: Column, carry: Column) -> Column:
    if how == "max":
        return F.greatest(within, carry)
    if how == "min":
        return F.least(within, carry)
    return F.coalesce(within, F.lit(0)) + F.coalesce(carry, F.lit(0))


def _carry(summary: DataFrame, keys: list[str], slice_col: str, tmp, totals) -> DataFrame:
    """What the slices before (after) a slice contribute, by a window over a key's summaries."""
    cols = []
    for _, _, sc, kc, s in tmp:
        cw = Window.partitionBy(*keys).orderBy(F.col(slice_col).desc() if s.side == "after" else F.col(slice_col))
        cols.append(_AGG[s.how](sc).over(cw.rowsBetween(Window.unboundedPreceding, -1)).alias(kc))
    cols += [F.sum(sc).over(Window.partitionBy(*keys)).alias(f"{s.name}_total") for _, _, sc, _, s in tmp if s.name in totals]
    return summary.select(*keys, slice_col, *cols)


def sliced_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str,
                slice_col: str, scans: Sequence[Scan], frame: str = "range",
                totals: Sequence[str] = (), levels: int = 1) -> DataFrame:
    """Add one column per ``Scan``: the aggregate of ``contrib`` over the rows of
    the same ``keys`` on the requested side of the row in ``order``.

    ``frame="range"`` needs a single numeric ``order`` column (ties are peers);
    ``frame="rows"`` takes a list of columns that must be unique per key.
    ``slice_col`` must be non-decreasing in ``order`` inside a key.
    ``totals`` names scans whose whole-key total is also wanted
    (``<name>_total``), for example a series size.

    ``levels`` above 1 makes the carry a tree: slices are grouped by ``SPREAD``, carried inside
    their group, and the groups' summaries scanned in the same way one level up.  A series of
    sparse slices (as many slices as rows) so never has more than ``SPREAD`` summaries in a window
    below the top, where rows / ``SPREAD`` ** (levels - 1) are left.
    """
    keys = list(keys)
    order_cols = [order] if isinstance(order, str) else list(order)
    part = keys + [slice_col]
    tmp = [(f"__c{i}", f"__w{i}", f"__s{i}", f"__k{i}", s) for i, s in enumerate(scans)]

    base = df.select("*", *[s.contrib.alias(c) for c, _, _, _, s in tmp])
    within = base.select("*", *[_AGG[s.how](c).over(_within_frame(part, order_cols, s.side, frame)).alias(wc)
                                for c, wc, _, _, s in tmp])

    # Summary per (key, slice), aggregated from the window's output: that is
    # already partitioned by (key, slice), so no exchange is added and the
    # input upstream of the window's shuffle is read once (the shuffle is
    # reused by both consumers).
    parts_of = {sc: [f"{sc}_{f}" for f in s.fields] for _, _, sc, _, s in tmp}
    summary = within.groupBy(*part).agg(*[a for c, _, sc, _, s in tmp for a in (
        [_AGG[s.how](c).alias(sc)] if not s.fields else
        [F.max(F.col(c)[s.fields[0]]).alias(parts_of[sc][0])]
        + [F.max_by(F.col(c)[f], F.col(c)[s.fields[0]]).alias(p) for f, p in zip(s.fields[1:], parts_of[sc][1:])])])
    for _, _, sc, _, s in tmp:
        if s.fields:
            first = F.col(parts_of[sc][0])
            summary = summary.withColumn(sc, F.when(first.isNotNull(), F.struct(
                *[F.col(p).alias(f) for f, p in zip(s.fields, parts_of[sc])]))).drop(*parts_of[sc])
    if levels > 1:
        group, own = f"_group{levels}", {sc: f"_{levels}{sc}" for _, _, sc, _, _ in tmp}
        up = sliced_scan(summary.select(*part, *[F.col(sc).alias(o) for sc, o in own.items()],
                                        F.floor(F.col(slice_col) / F.lit(SPREAD)).alias(group)),
                         keys, [slice_col], group,
                         [Scan(kc, F.col(own[sc]), s.how, "after" if s.side == "after" else "before", s.fields) for _, _, sc, kc, s in tmp],
                         frame="rows", totals=[kc for _, _, _, kc, s in tmp if s.name in totals], levels=levels - 1)
        carry = up.select(*part, *[F.col(kc) for _, _, _, kc, _ in tmp],
                          *[F.col(f"{kc}_total").alias(f"{s.name}_total") for _, _, _, kc, s in tmp if s.name in totals])
    else:
        carry = _carry(summary, keys, slice_col, tmp, totals)

    joined = within.join(carry, on=part, how="left")
    drop = {x for c, wc, sc, kc, _ in tmp for x in (c, wc, kc)}
    out = joined.select(*[F.col(c) for c in joined.columns if c not in drop],
                        *[_combine(s.how, F.col(wc), F.col(kc)).alias(s.name) for c, wc, _, kc, s in tmp])
    return out
