"""Display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# Fixed values that must equal the reference's: flag names in display order.
QUALITY_NAMES = [("is_normal", "Normalized"), ("is_reset", "Reset"),
                 ("is_duplicate", "Duplicate"), ("is_late", "Late"), ("is_bad", "Bad")]


def quality_label() -> Column:
    """Comma-separated names of the set flags, empty when none."""
    parts = [F.when(F.col(flag), F.lit(name)) for flag, name in QUALITY_NAMES]
    return F.concat_ws(", ", *parts)


def display(c, places: int = 3) -> Column:
    """Fixed decimals for table display (value and delta 3, totals 2)."""
    return F.format_number(_c(c), places)


def round_total(c, places: int = 2) -> Column:
    """Total rounded to at most ``places`` decimals."""
    return F.round(_c(c), places)
