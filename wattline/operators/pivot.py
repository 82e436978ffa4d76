"""Wide chart tables: pivot (A11) and bad-point overlay."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAD_PREFIX = "bad_"


def _quoted(name: str):
    """A column by its exact name (labels may hold dots or backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def long_table(df: DataFrame, value_col: str = "value", order: Sequence[str] = (), ts_col: str = "ts") -> DataFrame:
    """A11 without naming labels: one row (ts, label, value) each, the last row in
    ``order`` wins.  Any number of labels, none read on the driver."""
    key = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    return (df.where(F.col("label").isNotNull()).groupBy(ts_col, "label")
              .agg(F.max_by(F.col(value_col), key).alias(value_col)).orderBy(ts_col, "label"))


def pivot_labels(df: DataFrame, labels: Sequence[str], value_col: str = "value",
                 order: Sequence[str] = (), ts_col: str = "ts") -> DataFrame:
    """Rows (ts, label, value) -> one row per ts, one column per label
    (sorted), null when absent; on a repeated (ts, label) the last row in
    ``order`` wins."""
    labels = sorted(labels)
    key = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    return (df.withColumn("_k", key)
              .groupBy(ts_col).pivot("label", list(labels))
              .agg(F.max_by(F.col(value_col), F.col("_k")))
              .orderBy(ts_col))


def overlay_bad(wide: DataFrame, bad: DataFrame, labels: Sequence[str], value_col: str = "value",
                order: Sequence[str] = (), ts_col: str = "ts") -> DataFrame:
    """Attach bad points to the ts and labels of the good series as
    ``bad_<label>``; points at other ts or labels vanish; a matched point with
    a null value counts as 0; no point -> null."""
    labels = sorted(labels)
    key = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    b = (bad.where(F.col("label").isin(list(labels)) if labels else F.lit(False))
            .withColumn("_v", F.coalesce(F.col(value_col), F.lit(0.0)))
            .withColumn("_k", key)
            .groupBy(ts_col).pivot("label", list(labels))
            .agg(F.max_by(F.col("_v"), F.col("_k"))))
    have = set(b.columns)
    b = b.select(F.col(ts_col).alias("_bad_ts"),
                 *[(_quoted(lab) if lab in have else F.lit(None).cast("double")).alias(BAD_PREFIX + lab) for lab in labels])
    out = wide.join(b, F.col(ts_col) == F.col("_bad_ts"), "left")
    return out.select(*map(_quoted, wide.columns), *[_quoted(BAD_PREFIX + lab) for lab in labels]).orderBy(ts_col)


def empty_overlay(wide: DataFrame, labels: Sequence[str]) -> DataFrame:
    """J4 without bad points: every ``bad_<label>`` is null."""
    return wide.select("*", *[F.lit(None).cast("double").alias(BAD_PREFIX + lab) for lab in sorted(labels)])
