"""Deterministic keys (C7-C9) computed natively on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_key, _c

# Fixed value that must equal the reference's: the UUID namespace of the
# building and device keys.
KEY_NAMESPACE = "2f5d9c5d-6b32-4b6d-97aa-5f7c516f9833"
BUILDING_PREFIX = "building:"
DEVICE_PREFIX = "device:"


def uuid5_digest(name: Column, namespace: str = KEY_NAMESPACE) -> Column:
    """SHA-1 hex digest of namespace bytes + UTF-8 name (first step of a v5 UUID)."""
    ns = F.unhex(F.lit(namespace.replace("-", "")))
    # string -> binary is the UTF-8 encoding; unlike encode() it keeps the
    # expression non-nullable, so Catalyst does not infer (and push below the
    # input) an "is not null" test that would re-evaluate the whole digest.
    return F.sha1(F.concat(ns, F.coalesce(name, F.lit("")).cast("binary")))


def uuid5_format(digest: Column) -> Column:
    """Format a SHA-1 hex digest as an RFC 4122 version-5 UUID: keep 16 bytes,
    version nibble 5, variant bits 10 (the 17th hex digit maps to 8-b).

    Pass a column reference, not an expression: the digest is read six times.
    """
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-"),
        F.lit("5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def uuid5(name: Column, namespace: str = KEY_NAMESPACE) -> Column:
    """RFC 4122 name-based UUID (version 5) of ``name`` as one expression.

    Convenient for small inputs; large jobs use ``with_keys`` so the digest is
    computed once per row.
    """
    return uuid5_format(uuid5_digest(name, namespace))


def building_key_text(name) -> Column:
    return F.concat(F.lit(BUILDING_PREFIX), normalize_key(F.coalesce(_c(name), F.lit(""))))


def device_key_text(external_id) -> Column:
    return F.concat(F.lit(DEVICE_PREFIX), normalize_key(F.coalesce(_c(external_id), F.lit(""))))


def building_key(name) -> Column:
    """Key of a building from its name (case and padding ignored)."""
    return uuid5(building_key_text(name))


def device_key(external_id) -> Column:
    """Key of a device from its external id (case and padding ignored)."""
    return uuid5(device_key_text(external_id))


def with_keys(df: DataFrame, building_col: str = "building_name",
              device_col: str = "device_external_id") -> DataFrame:
    """Add ``building_id`` and ``device_id`` (C7, C8), hashing each name once."""
    return (df.withColumn("_bh", uuid5_digest(building_key_text(building_col)))
              .withColumn("_dh", uuid5_digest(device_key_text(device_col)))
              .withColumn("building_id", uuid5_format(F.col("_bh")))
              .withColumn("device_id", uuid5_format(F.col("_dh")))
              .drop("_bh", "_dh"))


def dedupe_key(explicit, external_id, metric, ts_text, value_text) -> Column:
    """Explicit key when non-empty, else SHA-256 hex of ``ext|metric|ts|value``.

    ``ts_text`` and ``value_text`` are the caller's renderings of the reading's
    timestamp and number; the same rendering must be used by every writer.
    """
    fallback = F.sha2(F.concat_ws("|", _c(external_id), _c(metric), _c(ts_text), _c(value_text)), 256)
    return F.coalesce(F.nullif(_c(explicit), F.lit("")), fallback)
