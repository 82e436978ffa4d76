"""Dimension resolution (J5, re-aimed): reuse the id of a known building name or
device external id, otherwise add a row with the deterministic key (C7/C8).

The reference's get-or-create resolver used random ids and tables its schema
lacks; here it is a left join + anti join + union over DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import building_key, device_key
from ..functions.text import normalize_key
from ..sources.manifest import Manifest
from ..sources.segments import due


def resolve_dimension(known: DataFrame, incoming: DataFrame, kind: str = "building") -> DataFrame:
    """Return the dimension table after resolving ``incoming`` names.

    ``known``: (id, name) for buildings or (id, external_id, name) for devices.
    ``incoming``: rows with ``name`` (buildings) or ``external_id`` (devices).
    Output: every known row, plus one new row per new normalised key, with
    ``is_new`` telling which.
    """
    key_col = "name" if kind == "building" else "external_id"
    keyfn = building_key if kind == "building" else device_key
    k = known.withColumn("_key", normalize_key(key_col))
    inc = (incoming.withColumn("_key", normalize_key(key_col))
           .groupBy("_key").agg(F.min(F.struct(*[c for c in incoming.columns])).alias("_r"))
           .select("_key", "_r.*"))
    new = inc.join(k.select("_key"), on="_key", how="left_anti").withColumn("id", keyfn(key_col))
    cols = [c for c in known.columns]
    new = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(known.schema[c].dataType).alias(c)
                       for c in cols], F.lit(True).alias("is_new"))
    return known.select(*cols, F.lit(False).alias("is_new")).unionByName(new)


def resolve_ids(known: DataFrame, incoming: DataFrame, kind: str = "building") -> DataFrame:
    """Incoming rows with the resolved ``id`` attached (known id wins)."""
    key_col = "name" if kind == "building" else "external_id"
    keyfn = building_key if kind == "building" else device_key
    k = (known.withColumn("_key", normalize_key(key_col))
         .groupBy("_key").agg(F.min("id").alias("_known_id")))
    return (incoming.withColumn("_key", normalize_key(key_col))
            .join(k, on="_key", how="left")
            .withColumn("id", F.coalesce(F.col("_known_id"), keyfn(key_col)))
            .drop("_key", "_known_id"))


# -- a dimension kept across triggers ------------------------------------------

DIMENSIONS = {"building": "id string, name string", "device": "id string, external_id string, name string"}
FAN, MAX_ROWS = 8, 1 << 24


def _segments(spark: SparkSession, path: str, kind: str, segments: list[dict]) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], DIMENSIONS[kind])
    return spark.read.schema(DIMENSIONS[kind]).parquet(*[f"{path.rstrip('/')}/{s['name']}" for s in segments])


def load_dimension(spark: SparkSession, path: str, kind: str = "building") -> DataFrame:
    """The dimension as of the last trigger."""
    return _segments(spark, path, kind, Manifest(spark, path).load()[1].get("segments", []))


def upsert_dimension(spark: SparkSession, incoming: DataFrame, path: str, batch_id: int, kind: str = "building") -> DataFrame:
    """J5 for one micro-batch: names that no earlier trigger brought are added as a segment; known
    ones keep their row.  A replay of the last trigger starts from the version before it and adds the
    same rows; an older one changes nothing.  Small segments are merged as those of the log are."""
    batch_id, manifest, path = int(batch_id), Manifest(spark, path), path.rstrip("/")
    if (manifest.versions() or [batch_id])[-1] > batch_id:
        return load_dimension(spark, path, kind)
    segments = manifest.load(before=batch_id)[1].get("segments", [])
    known = _segments(spark, path, kind, segments)
    name = f"level-0/batch-{batch_id}"
    columns = [c for c in incoming.columns if c in known.columns]
    new = resolve_dimension(known, incoming.select(*columns), kind).where("is_new").select(*known.columns)
    new.write.mode("overwrite").parquet(f"{path}/{name}")
    rows, written = _segments(spark, path, kind, [{"name": name}]).count(), [name]
    if rows:
        segments = [*segments, {"name": name, "level": 0, "rows": rows}]
    while side := due(segments, FAN, MAX_ROWS):
        level = side[0]["level"] + 1
        merged = {"name": f"level-{level}/batch-{batch_id}", "level": level, "rows": sum(s["rows"] for s in side)}
        _segments(spark, path, kind, side).write.mode("overwrite").parquet(f"{path}/{merged['name']}")
        written.append(merged["name"])
        at = segments.index(side[0])
        segments = [*segments[:at], merged, *segments[at + FAN:]]
    manifest.commit(batch_id, {"segments": segments, "written": written},
                    lambda c: [*(s["name"] for s in c.get("segments", [])), *c.get("written", [])])
    return _segments(spark, path, kind, segments)
