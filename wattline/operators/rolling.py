"""Rolling windows (W8, W9), mode selection (P5) and point classes.

Trailing frame ``t - width <= t' <= t`` per label.  Rows that share a ts are
taken one by one in input order, like a streaming queue: a row does not see
peers that come after it.

Linear frames: Spark sums a sliding ``RANGE`` frame anew for every row, so dense
readings under a long window cost rows times frame.  Here every row gets the
prefix sums up to itself, and those up to its frame's lower edge come from an
as-of scan over the same partitions (the last point of time before the edge);
the frame's sum is their difference.  Both scans are growing frames: one pass.

Skew: a label can be one huge series, so rows are cut into time slices; each
row also lands, as a read-only *halo* copy, in each following slice whose
start lies within ``width`` after it (the next slice only, with the default
slice width of at least eight windows).  Every frame is then complete inside
one ``(label, slice)`` partition and no task holds more than a slice plus its
halo.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("raw", "delta", "rolling_avg", "rolling_sum")
DEFAULT_MINUTES = 30


def window_micros(minutes) -> int:
    m = DEFAULT_MINUTES if minutes in (None, 0, "") else float(minutes)
    return int(max(1.0, m) * 60 * 1_000_000)


def rolling(df: DataFrame, mode: str, minutes=DEFAULT_MINUTES, by: Sequence[str] = ("label",),
            order: Sequence[str] = (), ts_col: str = "ts", slice_micros: int | None = None) -> DataFrame:
    """Write the rolling average of ``value`` (``rolling_avg``) or the
    rolling sum of ``coalesce(delta, 0)`` (``rolling_sum``) into ``value``.
    ``raw``/``delta`` return ``df`` unchanged.  ``order`` breaks ts ties."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode in ("raw", "delta"):
        return df
    by = list(by)
    width = window_micros(minutes)
    slice_w = slice_micros or max(8 * width, 86_400_000_000)
    base = (F.col("value") if mode == "rolling_avg" else F.coalesce(F.col("delta"), F.lit(0.0)))

    t = (df.withColumn("_t", F.unix_micros(F.col(ts_col)))
           .withColumn("_b", base)
           .withColumn("_s0", F.floor(F.col("_t") / F.lit(slice_w))))
    # Halo: a row is also needed by every later slice whose first frame
    # reaches back to it -- one slice when slices are wider than the window,
    # ceil(width / slice) of them otherwise.
    reach = -(-width // slice_w)
    offsets = F.sequence(F.lit(0), F.lit(reach))
    needed = F.filter(offsets, lambda j: (j == 0) | (F.col("_t") >= (F.col("_s0") + j) * F.lit(slice_w) - F.lit(width)))
    t = (t.withColumn("_off", F.explode(needed))
          .withColumn("_slice", F.col("_s0") + F.col("_off")))

    part = by + ["_slice"]
    t = _with_prefix(t, part, list(order))
    # The rows as points of time, each with the sums up to it, and for every row of the slice itself a
    # probe at its frame's lower edge, which stands before the points of its time.
    point = F.struct(F.col("_t").alias("at"), F.lit(1).alias("kind"))
    probe = F.struct((F.col("_t") - F.lit(width)).alias("at"), F.lit(0).alias("kind"))
    t = t.withColumn("_e", F.explode(F.when(F.col("_off") == 0, F.array(point, probe)).otherwise(F.array(point))))
    earlier = (Window.partitionBy(*part).orderBy("_e.at", "_e.kind", *order, "_off")
               .rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_edge", F.last(F.when(F.col("_e.kind") == 1, F.col("_upto")), ignorenulls=True).over(earlier))
    t = t.where("_e.kind = 0")

    def inside(name: str) -> Column:
        return F.col(f"_upto.{name}") - F.coalesce(F.col(f"_edge.{name}"), F.lit(0))

    c = inside("n")
    total = _total({k: inside(k) for k in _PREFIX})
    rolled = F.when(c > 0, total / c) if mode == "rolling_avg" else F.when(c > 0, total).otherwise(F.lit(0.0))
    return t.withColumn("value", rolled).drop("_t", "_b", "_s0", "_off", "_slice", "_upto", "_edge", "_e")


# Prefix sums are exact, so a value that has left the frame leaves no trace in it: values below 1e14 are
# decimals of 14 places, those below 1e28 whole decimals, and infinities and NaN are counted.  Only
# values beyond are summed as doubles (beside a count, so that they do not blur frames without any).
_LARGE, _HUGE = 1e14, 1e28
_PREFIX = ("n", "plain", "large", "huge", "n_huge", "n_up", "n_down", "n_nan")


def _with_prefix(t: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """Add ``_upto``: sums over the partition's rows up to each row (with all its peers when no
    order tells them apart).  Growing frames, so one pass."""
    w = Window.partitionBy(*part)
    w = (w.orderBy("_t", *order, "_off").rowsBetween(Window.unboundedPreceding, 0) if order
         else w.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    b = F.col("_b").cast("double")
    nan, up, down = F.isnan(b), b == float("inf"), b == float("-inf")
    size = F.abs(b)
    huge = ~nan & (size >= _HUGE) & ~up & ~down
    one = lambda cond: F.count(F.when(cond, 1)).over(w)
    exact = lambda cond, kind: F.coalesce(F.sum(F.when(cond, b.cast(kind))).over(w), F.lit(0).cast(kind))
    return t.withColumn("_upto", F.struct(
        F.count("_b").over(w).alias("n"),
        exact(~nan & (size < _LARGE), "decimal(38,14)").alias("plain"),
        exact(~nan & (size >= _LARGE) & (size < _HUGE), "decimal(38,0)").alias("large"),
        F.coalesce(F.sum(F.when(huge, b)).over(w), F.lit(0.0)).alias("huge"),
        one(huge).alias("n_huge"), one(up).alias("n_up"), one(down).alias("n_down"), one(nan).alias("n_nan")))


def _total(x: dict[str, Column]) -> Column:
    """The frame's sum as a double from its differences of prefix sums."""
    finite = (x["plain"].cast("double") + x["large"].cast("double")
              + F.when(x["n_huge"] > 0, x["huge"]).otherwise(F.lit(0.0)))
    return (F.when((x["n_nan"] > 0) | ((x["n_up"] > 0) & (x["n_down"] > 0)), F.lit(float("nan")))
            .when(x["n_up"] > 0, F.lit(float("inf"))).when(x["n_down"] > 0, F.lit(float("-inf"))).otherwise(finite))


def mode_value(mode: str) -> Column:
    """P5: the column a chart plots for ``mode`` after ``rolling``."""
    return F.col("delta") if mode == "delta" else F.col("value")


def split_points(df: DataFrame, mode: str = "raw") -> DataFrame:
    """Main / bad / late classes of the plotted value (late may overlap)."""
    v = mode_value(mode)
    return (df.withColumn("mainValue", F.when(~F.col("is_bad"), v))
              .withColumn("badValue", F.when(F.col("is_bad"), v))
              .withColumn("lateValue", F.when(F.col("is_late"), v)))
