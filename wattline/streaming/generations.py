"""Stored measurements that change by time slices (R2, S5; R3 and R4 follow from it).

The table is cut into parts: (bucket of the series, time slice).  A refresh rewrites the
parts that a micro-batch touches into a new generation folder and then switches the
manifest; all other parts stay as they are.  Nothing is overwritten in place.

What a new reading can change is local.  Its own flags and delta need the readings of
its slice, the last good ones before that slice, and the latest good original of its
series.  Of the stored rows it can only change those after it up to the next good
original.  So beside the rows the table keeps, for every series and slice, a state:

* ``orig``: the last good original of the slice; ``any``: its last good reading of any
  kind, with the first arrival at that time (both as structs that order by time);
* ``c_orig``, ``c_any``: the same over all earlier slices -- the carry into the slice;

and for every series a head: its last slice, and both over all slices.  A refresh

1. finds the slices its readings fall into; readings past their series' head need
   nothing else, and late ones ask the states ahead, a few slices at a time, for the
   slices up to the next good original (the touched slices);
2. derives the new readings together with the stored rows of the touched slices and the
   carried rows (``derive_placed``, either delta mode);
3. keeps a stored row's delta unless the reading it is taken against now is a new one;
4. writes the touched parts, their states, heads, key filters (for ``existing_stored``) and
   rollup (for ``plans.rollup``) as a generation, and switches.

It reads and writes touched parts, their states, and the heads of touched buckets:
slices and series, not history.  A replay of the last micro-batch starts from the
version before it and writes the same generation again; an older one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import time_range
from ..functions.text import ENERGY_METRIC, LEGACY_ENERGY_METRIC
from ..functions.time import bucket
from ..operators.measure import arrival_key, derive_placed, normalize, placeable
from ..schemas import MEASUREMENT, MEASUREMENT_COLUMNS, SERIES
from ..session import Scratch, materialize
from ..sources.batches import DEFAULT_BUCKETS, measurement_bucket
from ..sources.manifest import Manifest

SLICE_HOURS = 24
SCAN_HOURS = 24  # of a window in the derivation: hourly readings have a summary a day, not one each
PAIR = ["bucket", *SERIES, "slice"]
_READING = "ts: timestamp, arrival_seq: long, reading_id: long, value: double"
_ORIG = f"struct<{_READING}>"
_ANY = f"struct<{_READING}, f_seq: long, f_id: long, f_value: double, f_bad: boolean>"
STATES = (f"bucket long, device_id string, metric string, slice long, has_orig boolean, orig {_ORIG}, any {_ANY}, "
          f"c_orig {_ORIG}, c_any {_ANY}")
HEADS = f"bucket long, device_id string, metric string, last_slice long, orig {_ORIG}, any {_ANY}"
ROLLUP = ("bucket long, slice long, ts timestamp, building_id string, building_name string, device_id string, metric string, "
          "is_bad boolean, n long, sum_value double, sum_delta double")
ROLLUP_MINUTES = 15
FILTERS = "bucket long, slice long, block long, bits binary"
ROWS = T.StructType([*MEASUREMENT, T.StructField("bucket", T.LongType()), T.StructField("slice", T.LongType())])


def slice_of(ts: Column | str, hours: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(hours * 3_600_000_000)).cast("long")


class Store:
    """One version of the table: the generation of each live part and head."""

    def __init__(self, spark: SparkSession, path: str, content: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self.hours, self.buckets = content.get("hours", SLICE_HOURS), content.get("buckets", DEFAULT_BUCKETS)
        self.parts: dict[tuple[int, int], list[int]] = {tuple(map(int, k.split("/"))): v for k, v in content.get("parts", {}).items()}
        self.heads: dict[int, int] = {int(k): v for k, v in content.get("heads", {}).items()}

    def content(self, **more) -> dict:
        return {"hours": self.hours, "buckets": self.buckets, "parts": {f"{b}/{s}": v for (b, s), v in self.parts.items()},
                "heads": {str(b): g for b, g in self.heads.items()}, **more}

    def folder(self, kind: str, bucket: int, at: int | None = None, generation: int | None = None) -> str:
        generation = generation if generation is not None else self.heads[bucket] if at is None else self.parts[bucket, at][0]
        return f"{kind}/generation={generation}/p_bucket={bucket}" + ("" if at is None else f"/p_slice={at}")

    def _read(self, schema, folders: list[str]) -> DataFrame:
        """The folders as one table; bucket and slice stand in the rows too."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def rows(self, parts) -> DataFrame:
        return self._read(ROWS, [self.folder("rows", b, s) for b, s in parts])

    def states(self, parts) -> DataFrame:
        return self._read(STATES, [self.folder("states", b, s) for b, s in parts])

    def series_heads(self, buckets) -> DataFrame:
        return self._read(HEADS, [self.folder("heads", b) for b in buckets if b in self.heads])


    def rollup(self, parts) -> DataFrame:
        return self._read(ROLLUP, [self.folder("rollup", b, s) for b, s in parts])

    def parts_of(self, device: str | None = None, metrics=(), start=None, end=None) -> list[tuple[int, int]]:
        """Live parts that a device (with its metrics) and a range of time can be in."""
        parts = sorted(self.parts)
        if device is not None:
            homes = self.spark.range(1).select(*[measurement_bucket(F.lit(device), F.lit(n), self.buckets) for n in metrics]).first()
            parts = [p for p in parts if p[0] in set(homes)]
        low, high = self.spark.range(1).select(*[F.lit(None).cast("long") if x is None else slice_of(F.lit(x).cast("timestamp"), self.hours)
                                                 for x in (start, end)]).first()
        return [(b, s) for b, s in parts if (low is None or s >= low) and (high is None or s <= high)]

    def filters(self, parts) -> DataFrame:
        return self._read(FILTERS, [self.folder("filters", b, s) for b, s in parts])


def folders_of(content: dict) -> list[str]:
    store = Store(None, "", content)
    return [*(store.folder(kind, *part) for part in store.parts for kind in ("rows", "states", "filters", "rollup")),
            *(store.folder("heads", b) for b in store.heads)]


def current(spark: SparkSession, path: str) -> Store | None:
    version, content = Manifest(spark, path).load()
    return None if version is None else Store(spark, path, content)


def load_slices(spark: SparkSession, path: str, device: str | None = None, metric: str = ENERGY_METRIC, start=None,
                end=None) -> DataFrame:
    """S4 over the sliced store: a device (with its metric) opens its bucket only, a time
    range only its slices."""
    store = current(spark, path)
    names = sorted({metric, LEGACY_ENERGY_METRIC} if metric == ENERGY_METRIC else {metric})
    df = store.rows(store.parts_of(device, names, start, end))
    if device is not None:
        df = df.where((F.col("device_id") == device) & F.col("metric").isin(names))
    return df.where(time_range(start, end)).select(*MEASUREMENT_COLUMNS)


# -- states ------------------------------------------------------------------

def own_states(rows: DataFrame) -> DataFrame:
    """bucket, series, slice, orig, any of measurement rows.  Copies at one time are
    combined in the tasks that read them; then a slice's times are."""
    good = ~F.col("is_bad")
    at = F.struct("ts", "arrival_seq", "reading_id", "value")
    times = rows.groupBy(*PAIR, "ts").agg(
        F.max(F.when(good & ~F.col("is_duplicate"), at)).alias("orig"), F.max(F.when(good, at)).alias("last"),
        F.min_by(F.struct(F.col("arrival_seq").alias("f_seq"), F.col("reading_id").alias("f_id"), F.col("value").alias("f_value"),
                          F.col("is_bad").alias("f_bad")), arrival_key("arrival_seq", "reading_id")).alias("_f"))
    with_last = times.select(*PAIR, "orig", F.when(F.col("last").isNotNull(), F.struct(
        "last.ts", "last.arrival_seq", "last.reading_id", "last.value", "_f.f_seq", "_f.f_id", "_f.f_value", "_f.f_bad")).alias("any"))
    return with_last.groupBy(*PAIR).agg(F.max("orig").alias("orig"), F.max("any").alias("any"))


def rolled_up(rows: DataFrame) -> DataFrame:
    """Mergeable sums and counts of originals by quarter of an hour, building, device, metric and
    quality (``ROLLUP``); sums over them give every bucket that is a multiple and every total."""
    return (rows.where(~F.col("is_duplicate")).groupBy("bucket", "slice", bucket("ts", ROLLUP_MINUTES).alias("ts"), "building_id",
                                                       "building_name", "device_id", "metric", "is_bad")
            .agg(F.count("value").alias("n"), F.sum("value").alias("sum_value"), F.sum(F.coalesce("delta", F.lit(0.0))).alias("sum_delta")))


# -- existence probe -----------------------------------------------------------

BLOCK_BITS = 32_768   # of one bitmap
KEY_BITS, PROBES = 12, 3


def _blocks_of(rows: Column) -> Column:
    """Bitmaps in the filter of a part with so many rows."""
    return F.ceil(rows * KEY_BITS / BLOCK_BITS).cast("long")


def _spots(keyed: DataFrame) -> DataFrame:
    """The bits of a key in the filter of its part (``blocks`` bitmaps): block, bit."""
    h = F.xxhash64("device_id", "metric", "ts")
    return (keyed.withColumn("spot", F.explode(F.array(*[F.pmod(F.xxhash64(h, F.lit(k)), F.col("blocks") * BLOCK_BITS) for k in range(PROBES)])))
            .withColumn("block", F.floor(F.col("spot") / BLOCK_BITS).cast("long")).withColumn("bit", F.col("spot") % BLOCK_BITS).drop("spot"))


def _with_blocks(keyed: DataFrame, sizes: dict[tuple[int, int], int]) -> DataFrame:
    """Keys of the named parts with their filter's number of bitmaps (one row per part is sent along)."""
    parts = keyed.sparkSession.createDataFrame([(*p, n) for p, n in sizes.items()], "bucket long, slice long, n long")
    return keyed.join(F.broadcast(parts.select("bucket", "slice", _blocks_of(F.col("n")).alias("blocks"))), ["bucket", "slice"])


def _write_filters(rows: DataFrame, sizes: dict[tuple[int, int], int], path: str) -> None:
    """One Bloom filter per part over its keys (device, metric, ts), as bitmaps.

    A bitmap is named by one number while it is built (parts are counted, their bitmaps numbered on):
    the aggregate sorts three rows a key, and one number is sorted by radix."""
    total, at = 0, []
    for (b, s), n in sizes.items():
        blocks = -(-n * KEY_BITS // BLOCK_BITS)
        at.append((b, s, blocks, total))
        total += blocks
    parts = F.broadcast(rows.sparkSession.createDataFrame(at, "bucket long, slice long, blocks long, first long"))
    spots = _spots(rows.select("bucket", "slice", *SERIES, "ts").join(parts, ["bucket", "slice"]))
    built = (spots.select((F.col("first") + F.col("block")).alias("number"), "bucket", "slice", "block", "bit").groupBy("number")
             .agg(*[F.min(c).alias(c) for c in ("bucket", "slice", "block")], F.bitmap_construct_agg("bit").alias("bits")))
    _write(built.drop("number"), path, ["bucket", "slice"], ["block"])


def existing_stored(spark: SparkSession, batch: DataFrame, path: str) -> DataFrame:
    """J1 against the stored table: the rows of ``batch`` (series, ts) that it holds already.

    Only parts that the batch falls into are asked, by their filters first; rows are read
    from those parts alone whose filter may hold a key, and compared exactly."""
    store = current(spark, path)
    if store is None:
        return batch.limit(0)
    keys = materialize(batch.select(*SERIES, "ts").distinct().withColumn("bucket", measurement_bucket("device_id", "metric", store.buckets))
                       .withColumn("slice", slice_of("ts", store.hours)), "probed-keys")
    asked = [p for p in sorted((r["bucket"], r["slice"]) for r in keys.select("bucket", "slice").distinct().collect()) if p in store.parts]
    if not asked:
        return batch.limit(0)
    spots = _spots(_with_blocks(keys, {p: store.parts[p][1] for p in asked}))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    lit = F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1
    may = (spots.join(store.filters(asked), ["bucket", "slice", "block"]).groupBy(*PAIR, "ts")
           .agg(F.sum(lit.cast("int")).alias("n")).where(F.col("n") == PROBES))
    may = materialize(may.select(*PAIR, "ts"), "possible-keys")
    parts = sorted((r["bucket"], r["slice"]) for r in may.select("bucket", "slice").distinct().collect())
    held = store.rows(parts).select(*SERIES, "ts").join(may.select(*SERIES, "ts"), [*SERIES, "ts"], "left_semi")
    return batch.join(held, [*SERIES, "ts"], "left_semi")


# -- refresh -----------------------------------------------------------------

def _same(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    return left.join(right, list(keys), how)


def _ahead(store: Store, scratch: Scratch, late: DataFrame) -> DataFrame | None:
    """States after each late pair (``late``: pair, ``last_slice``) up to the first with a good
    original, with the late slice as ``from_slice`` and the carry; None without late pairs.

    The states are asked for 1, 4, 16, ... slices ahead until every pair has met one, so
    how much is read depends on how far the next good original is, not on the history."""
    asked = {(r["bucket"], r["slice"]) for r in late.select("bucket", "slice").distinct().collect()}  # parts, not rows
    if not asked:
        return None
    late, reach = scratch(late.select(*PAIR, "last_slice"), "late-pairs"), 1
    while True:
        wanted = {b: [s for b2, s in asked if b2 == b] for b in {b for b, _ in asked}}
        parts = [(b, s) for b, s in sorted(store.parts) if any(a < s <= a + reach for a in wanted.get(b, ()))]
        ahead = store.states(parts).withColumnRenamed("slice", "to_slice")
        met = late.join(ahead, ["bucket", *SERIES]).where((F.col("to_slice") > F.col("slice")) & (F.col("to_slice") <= F.col("slice") + reach))
        first = met.groupBy(*PAIR).agg(F.min(F.when(F.col("has_orig"), F.col("to_slice"))).alias("until"))
        found = (_same(met, first, PAIR, "inner").where(F.col("to_slice") <= F.coalesce("until", "to_slice"))
                 .withColumnsRenamed({"slice": "from_slice", "to_slice": "slice"}))
        open_ = _same(late, first, PAIR).where(F.col("until").isNull() & (F.col("last_slice") > F.col("slice") + reach))
        if not open_.limit(1).count():
            return scratch(found.select(*PAIR, "from_slice", "c_orig", "c_any"), "slices-ahead")
        reach *= 4


def _seed_rows(carried: DataFrame) -> DataFrame:
    """Carried readings (series, orig, any) as rows to derive with: the good original, the last
    good reading and the first arrival at its time."""
    def rows(ts, seq, ident, value, bad, when):
        return carried.where(when).select(
            *SERIES, F.col(ts).alias("ts"), F.col(seq).alias("arrival_seq"), F.col(ident).alias("reading_id"), F.col(value).alias("value"),
            (F.col(bad) if isinstance(bad, str) else F.lit(bad)).alias("is_bad"))
    return (rows("orig.ts", "orig.arrival_seq", "orig.reading_id", "orig.value", False, F.col("orig").isNotNull())
            .unionByName(rows("any.ts", "any.arrival_seq", "any.reading_id", "any.value", False, F.col("any").isNotNull()))
            .unionByName(rows("any.ts", "any.f_seq", "any.f_id", "any.f_value", "any.f_bad", F.col("any").isNotNull()))
            .distinct())


def _write(rows: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """One folder per part, its files in order.  Parts are dealt whole, and AQE splits a part that is
    large over several tasks; ranges of the order would run the whole plan once more to sample it.
    The order begins with the folder columns themselves, so that the write adds no sort of its own."""
    folders = [f"p_{c}" for c in by]
    (rows.withColumns({f"p_{c}": F.col(c) for c in by}).hint("rebalance", *folders).sortWithinPartitions(*folders, *order)
     .write.mode("overwrite").partitionBy(*folders).parquet(path))


def refresh_slices(spark: SparkSession, readings: DataFrame, path: str, batch_id: int, delta_mode: str = "event_time",
                   buckets: int = DEFAULT_BUCKETS, hours: int = SLICE_HOURS) -> dict:
    """Take the readings of one micro-batch, which arrived after all stored ones, into the
    table at ``path``.  Returns what was read and written (parts and their rows)."""
    batch_id, manifest = int(batch_id), Manifest(spark, path)
    if (manifest.versions() or [batch_id])[-1] > batch_id:
        return {}
    store = Store(spark, path, manifest.load(before=batch_id)[1] or {"hours": hours, "buckets": buckets})
    scratch = Scratch(spark)
    try:
        return _refreshed(store, manifest, scratch, readings, batch_id, delta_mode)
    finally:
        scratch.drop()


def _refreshed(store: Store, manifest: Manifest, scratch: Scratch, readings: DataFrame, batch_id: int, delta_mode: str) -> dict:
    spark = store.spark
    n = normalize(readings)
    n = n.where(placeable(n))
    new = scratch(n.select("arrival_seq", "reading_id", "building_id", "building_name", "device_id", "device_external_id", "device_name",
                               "ts", "metric", "value", "unit", "is_normal", "is_bad", "ingest_time").withColumn("bucket", measurement_bucket("device_id", "metric", store.buckets))
                      .withColumn("slice", slice_of("ts", store.hours)), "new-readings")
    pairs = scratch(new.groupBy(*PAIR).agg(F.max("ts").alias("max_ts"), F.min("arrival_seq").alias("first_seq")), "new-pairs")
    seen = {(r["bucket"], r["slice"]): r["seq"] for r in pairs.groupBy("bucket", "slice").agg(F.min("first_seq").alias("seq")).collect()}
    mine = sorted(seen)  # parts, not rows
    if not mine:
        manifest.commit(batch_id, store.content(), folders_of)
        return {"rows_read": 0, "parts_read": 0, "parts_written": 0}
    heads = store.series_heads(sorted({b for b, _ in mine}))
    known = store.states([p for p in mine if p in store.parts]).select(
        *PAIR, F.col("orig").alias("s_orig"), F.col("c_orig").alias("s_c_orig"), F.col("c_any").alias("s_c_any"), F.lit(True).alias("known"))
    own = scratch(_same(_same(pairs, heads.withColumnsRenamed({"orig": "h_orig", "any": "h_any"}), ["bucket", *SERIES]), known, PAIR), "touched")
    # A late reading before its slice's last good original meets the next one inside the slice.
    beyond = F.col("s_orig").isNull() | (F.col("max_ts") >= F.col("s_orig.ts"))
    ahead = _ahead(store, scratch, own.where((F.col("slice") < F.col("last_slice")) & beyond))
    # The carry into a touched slice: its own, that of the next one where it is new among older
    # slices, or the head's where it lies past it.
    own_carry = [F.when(F.col("known"), F.col(f"s_c_{x}")).when(F.col("slice") > F.col("last_slice"), F.col(f"h_{x}")) for x in ("orig", "any")]
    if ahead is None:
        region, opened = own.select(*PAIR, own_carry[0].alias("c_orig"), own_carry[1].alias("c_any")), mine
    else:
        nearest = ahead.groupBy("bucket", *SERIES, F.col("from_slice").alias("slice")).agg(
            F.min_by(F.struct("c_orig", "c_any"), "slice").alias("next"))
        carried = (_same(own, nearest, PAIR)
                   .select(*PAIR, own_carry[0].otherwise(F.col("next.c_orig")).alias("c_orig"), own_carry[1].otherwise(F.col("next.c_any")).alias("c_any"))
                   .unionByName(ahead.select(*PAIR, "c_orig", "c_any")))
        region = scratch(carried.dropDuplicates(PAIR), "region")
        opened = sorted((r["bucket"], r["slice"]) for r in region.select("bucket", "slice").distinct().collect())  # parts, not rows
    stored = store.rows([p for p in opened if p in store.parts])
    inside = region.select(*PAIR, F.lit(True).alias("_in"))
    marked = _same(stored, inside, PAIR)
    seeds = _seed_rows(region.select(*SERIES, F.col("c_orig").alias("orig"), F.col("c_any").alias("any")).unionByName(
        own.select(*SERIES, F.col("h_orig").alias("orig"), F.lit(None).cast(_ANY).alias("any")).distinct()))
    seeds = seeds.withColumn("slice", slice_of("ts", store.hours)).join(region.select(*SERIES, "slice"), [*SERIES, "slice"], "left_anti")
    flags = ["is_duplicate", "is_late", "is_reset", "delta", "created_at", "updated_at", "raw_event_id"]
    united = (new.withColumn("_kind", F.lit(0))
              .unionByName(marked.where("_in").drop("_in").withColumn("ingest_time", F.col("created_at"))
                           .withColumnsRenamed({c: f"s_{c}" for c in flags}).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
              .unionByName(seeds.withColumn("_kind", F.lit(2)), allowMissingColumns=True))
    # Written once: the derivation reads it in several branches, each of which would repeat the joins above.
    derived = derive_placed(scratch(united, "united"), delta_mode, SCAN_HOURS * 3600, keep=["_kind", "bucket", "slice", *(f"s_{c}" for c in flags)], source="_source", write_step=scratch)
    fresh = F.col("_kind") == 0
    taken = fresh | (F.col("_source") >= F.lit(min(seen.values())).cast("decimal(38,0)") * F.lit("10000000000000000000").cast("decimal(20,0)"))
    changed = derived.where("_kind < 2").select(
        *[F.when(F.coalesce(taken, F.lit(False)), F.col(c)).otherwise(F.col(f"s_{c}")).alias(c) if c in ("delta", "is_reset")
          else F.when(fresh, F.col(c)).otherwise(F.col(f"s_{c}")).alias(c) if c in flags else F.col(c) for c in MEASUREMENT_COLUMNS],
        "bucket", "slice")
    rest = marked.where("_in is null").select(*MEASUREMENT_COLUMNS, "bucket", "slice")
    root = f"{store.path}/rows/generation={batch_id}"
    _write(changed.withColumn("derived", F.lit(True)).unionByName(rest.withColumn("derived", F.lit(False))), root,
           ["bucket", "slice"], [*SERIES, "ts"])
    written = spark.read.schema(T.StructType([*ROWS, T.StructField("derived", T.BooleanType())])).option(
        "recursiveFileLookup", "true").parquet(root)
    read = [p for p in opened if p in store.parts]
    counts = {(r["bucket"], r["slice"]): r["count"] for r in written.groupBy("bucket", "slice").count().collect()}  # parts
    _write_states(store, batch_id, written, region, opened)
    _write_heads(store, batch_id, own, sorted({b for b, _ in mine}))
    _write_filters(written, counts, f"{store.path}/filters/generation={batch_id}")
    _write(rolled_up(written), f"{store.path}/rollup/generation={batch_id}", ["bucket", "slice"], ["ts", "building_id", "device_id"])
    stats = {"rows_read": sum(store.parts[p][1] for p in read), "parts_read": len(read), "parts_written": len(opened)}
    store.parts.update({p: [batch_id, counts[p]] for p in opened})
    store.heads.update({b: batch_id for b, _ in opened})
    manifest.commit(batch_id, store.content(stats=stats), folders_of)
    return stats


def _write_states(store: Store, generation: int, written: DataFrame, region: DataFrame, opened) -> None:
    """States of the touched slices, anew from their rows (those derived) and the carry; those of other series are copied."""
    earlier = Window.partitionBy("bucket", *SERIES).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = _same(own_states(written.where("derived")), region.select(*PAIR, F.col("c_orig").alias("o_orig"), F.col("c_any").alias("o_any")), PAIR, "inner")
    fresh = inside.select(*PAIR, F.col("orig").isNotNull().alias("has_orig"), "orig", "any",
                          F.greatest("o_orig", F.max("orig").over(earlier)).alias("c_orig"),
                          F.greatest("o_any", F.max("any").over(earlier)).alias("c_any"))
    kept = _same(store.states([p for p in opened if p in store.parts]), region.select(*PAIR), PAIR, "left_anti")
    _write(fresh.unionByName(kept), f"{store.path}/states/generation={generation}", ["bucket", "slice"], SERIES)


def _write_heads(store: Store, generation: int, own: DataFrame, buckets: list[int]) -> None:
    """Heads of the touched buckets: those of the touched series moved on by their new states."""
    opened = [f"{store.path}/states/generation={generation}"]
    states = store.spark.read.schema(STATES).option("recursiveFileLookup", "true").parquet(*opened)
    moved = (_same(states, own.select("bucket", *SERIES).distinct(), ["bucket", *SERIES], "left_semi").groupBy("bucket", *SERIES)
             .agg(F.max("slice").alias("n_slice"), F.max("orig").alias("n_orig"), F.max("any").alias("n_any")))
    heads = store.series_heads(buckets).join(moved, ["bucket", *SERIES], "full").select(
        "bucket", *SERIES, F.greatest("last_slice", "n_slice").alias("last_slice"), F.greatest("orig", "n_orig").alias("orig"),
        F.greatest("any", "n_any").alias("any"))
    _write(heads, f"{store.path}/heads/generation={generation}", ["bucket"], SERIES)
