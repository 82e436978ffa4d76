"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import types
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized_root
from ..sources.tables import table

__all__ = ["table", "stored", "texts", "crc_mod", "batches_of", "slices", "record", "broadcast_if_small", "worker_state",
           "forget"]


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: the lineage ends there, so a lost executor recomputes nothing before
    this point, and several branches can read the rows."""
    path = f"{materialized_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null: empty) and the named columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def crc_mod(column: str, modulus: int):
    """crc32 of the column's text, modulo ``modulus``; a null counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def batches_of(batches, *columns: str):
    """Arrow batches as tuples of Python lists, one list per named column."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)


def slices(batches, column: str, most: int = 1_000_000):
    """The batches in slices of whole rows, cut where ``column`` passes ``most`` bytes (a longer row goes alone)."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        at, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and size + n > most:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if b.num_rows > at:
            yield b.slice(at)


def record(schema: pa.Schema, columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from lists or arrays in its order."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema)


def broadcast_if_small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast ``df`` only when its counted rows stay within ``bound``; a
    larger side goes through the ordinary shuffled join."""
    return F.broadcast(df) if rows <= bound else df


def worker_state() -> dict:
    """What a Python worker keeps from one task to the next (functions travel by
    value, so their modules' globals do not last)."""
    return sys.modules.setdefault("wattline_worker_state", types.ModuleType("wattline_worker_state")).__dict__


def forget(*names: str) -> None:
    """Drop what the worker kept under these names and give its free memory back, for
    the tasks and stages that follow in the same process."""
    for name in names:
        worker_state().pop(name, None)
    pa.default_memory_pool().release_unused()
