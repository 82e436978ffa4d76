"""The reading log as levelled segments (S3).

Every batch is one segment: a folder whose files are sorted by (bucket, device, metric,
time), so a reader of some buckets skips row groups.  When ``fan`` segments of one level
stand side by side they are merged into one of the next level, so any number of triggers
leaves at most ``fan`` segments a level and a reading is rewritten once per level.  A
merge that would pass ``max_rows`` is not made: large segments stay as they are.

The manifest names the live segments; readers open these and list nothing else.  A replay
of the last batch starts from the version before it and ends with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LOG
from .manifest import Manifest

FAN = 8
MAX_ROWS = 1 << 30
ORDER = ("bucket", "device_external_id", "metric", "ts")


def _folders(content: dict):
    """Folders of a version: the live ones, and those it wrote that a merge has replaced."""
    return [*(s["name"] for s in content.get("segments", [])), *content.get("written", [])]


def _write(rows: DataFrame, path: str) -> None:
    """Devices are dealt over the files, a large one over several by AQE; ranges of the order would
    run the whole plan (parsing, numbering) once more to sample it."""
    (rows.select(*LOG.names).hint("rebalance", *ORDER[:2]).sortWithinPartitions(*ORDER)
     .write.mode("overwrite").parquet(path))


def read_segments(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    if not segments:
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(*[f"{path.rstrip('/')}/{s['name']}" for s in segments])


def live_segments(spark: SparkSession, path: str) -> list[dict]:
    return Manifest(spark, path).load()[1].get("segments", [])


def rows_before(spark: SparkSession, path: str, batch_id: int) -> int:
    """How many readings the batches before ``batch_id`` took: the first number of its own,
    the same on a replay."""
    return sum(s["rows"] for s in Manifest(spark, path).load(before=int(batch_id))[1].get("segments", []))


def append_segment(readings: DataFrame, path: str, batch_id: int, fan: int = FAN, max_rows: int = MAX_ROWS) -> DataFrame:
    """Append one batch (``LOG`` columns) and merge what is due; returns its rows.

    A batch that a later one has followed is complete; it is left as it is."""
    spark, batch_id, path = readings.sparkSession, int(batch_id), path.rstrip("/")
    manifest = Manifest(spark, path)
    if (manifest.versions() or [batch_id])[-1] > batch_id:
        return read_segments(spark, path, manifest.load()[1]["segments"]).where(F.col("batch_id") == batch_id)
    segments = manifest.load(before=batch_id)[1].get("segments", [])
    name = f"level-0/batch-{batch_id}"
    _write(readings, f"{path}/{name}")
    own = read_segments(spark, path, [{"name": name}])
    rows, written = own.count(), [name]
    if rows:
        segments = [*segments, {"name": name, "level": 0, "first": batch_id, "last": batch_id, "rows": rows}]
        segments = merged(spark, path, segments, fan, max_rows, written)
    manifest.commit(batch_id, {"segments": segments, "written": written}, _folders)
    return own


def due(segments: list[dict], fan: int, max_rows: int) -> list[dict]:
    """The segments to merge next: the last ``fan`` of one level, if together they are small enough."""
    for level in sorted({s["level"] for s in segments}):
        side = [s for s in segments if s["level"] == level][-fan:]
        if len(side) == fan and sum(s["rows"] for s in side) <= max_rows:
            return side
    return []


def merged(spark: SparkSession, path: str, segments: list[dict], fan: int, max_rows: int, written: list[str]) -> list[dict]:
    """The segments after all merges that are due; ``written`` takes the folders these write."""
    while side := due(segments, fan, max_rows):
        level, first, last = side[0]["level"] + 1, side[0]["first"], side[-1]["last"]
        name = f"level-{level}/batches-{first}-{last}"
        _write(read_segments(spark, path, side), f"{path}/{name}")
        new = {"name": name, "level": level, "first": first, "last": last, "rows": sum(s["rows"] for s in side)}
        at = segments.index(side[0])
        segments = [*segments[:at], new, *segments[at + fan:]]
        written.append(name)
    return segments
