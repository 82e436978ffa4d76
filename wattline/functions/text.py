"""Text and unit normalisation (C1-C6, C16) as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
# Metric spellings that all mean cumulative energy, and its canonical name/unit.
ENERGY_ALIASES = ["energy", "energy_total", "energy_kwh_total"]
ENERGY_METRIC = "energy_kwh_total"
LEGACY_ENERGY_METRIC = "energy"
KWH_UNIT = "kWh"
# Unit spellings (after lower-casing) that are accepted for energy.
UNIT_KWH = "kwh"
UNIT_WH = "wh"

# Every character Python's str.strip() removes (str.isspace() is true); Java's
# \s and Spark's plain trim only cover ASCII / spaces, so the set is spelled out.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_space(c) -> Column:
    """Remove surrounding whitespace the way Python's ``str.strip`` does
    (a character-set trim, no regular expression)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def normalize_key(c) -> Column:
    """Lower-case and strip surrounding whitespace."""
    return F.lower(strip_space(c))


def _key(c, keyed: bool) -> Column:
    return _c(c) if keyed else normalize_key(c)


def is_energy(metric, keyed: bool = False) -> Column:
    return _key(metric, keyed).isin(ENERGY_ALIASES)


def canonical_metric(metric, keyed: bool = False) -> Column:
    """Energy aliases -> ``energy_kwh_total``; anything else normalised.

    ``keyed=True`` means the argument already went through ``normalize_key``.
    """
    m = _key(metric, keyed)
    return F.when(m.isin(ENERGY_ALIASES), F.lit(ENERGY_METRIC)).otherwise(m)


def canonical_unit(metric, unit, keyed: bool = False, raw_unit=None) -> Column:
    """Energy in kWh/Wh -> ``kWh``; energy in another unit keeps the unit as
    sent; other metrics get the normalised unit."""
    u = _key(unit, keyed)
    sent = _c(raw_unit) if raw_unit is not None else _c(unit)
    e = is_energy(metric, keyed)
    return (F.when(e & u.isin(UNIT_KWH, UNIT_WH), F.lit(KWH_UNIT))
            .when(e, sent)
            .otherwise(u))


def canonical_value(metric, unit, value, keyed: bool = False) -> Column:
    """C4: energy in Wh is divided by 1000; everything else unchanged."""
    v = _c(value).cast("double")
    return F.when(is_energy(metric, keyed) & (_key(unit, keyed) == UNIT_WH), v / F.lit(1000.0)).otherwise(v)


def is_normal_flag(metric, unit, keyed: bool = False) -> Column:
    """True only when the value was converted from Wh."""
    return is_energy(metric, keyed) & (_key(unit, keyed) == UNIT_WH)


def is_bad_flag(metric, unit, keyed: bool = False) -> Column:
    """True only for energy in a unit other than kWh/Wh."""
    return is_energy(metric, keyed) & ~_key(unit, keyed).isin(UNIT_KWH, UNIT_WH)


def payload_json(col: Column, dtype) -> Column:
    """Payload as JSON text: struct/map/array -> JSON text, string kept."""
    from pyspark.sql.types import StringType
    if isinstance(dtype, StringType):
        return col
    return F.when(col.isNull(), F.lit(None).cast("string")).otherwise(F.to_json(col))
