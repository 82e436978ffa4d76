"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself join its smallest neighbour; edges are a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return joined.union(least.select(F.col("m").alias("a"), "b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours join its smallest neighbour (or the node itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node with an edge (component: its smallest node).

    Rounds end when the star edges no longer change; each round's edges are
    written to the shared folder, so lineage stays short."""
    now = stored(edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
                 .where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        then = stored(_small_star(_large_star(now)).distinct(), "edges")
        after = _state(then)
        now, stable, state = then, after == state, after
        if stable:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a"), F.col("a")).distinct())
