"""Line de-duplication against levelled sorted runs (operator 13).

A run is a table of line hashes, bucketed and sorted by hash: hash, how many documents
hold the line, and its keeper, the largest doc_id that holds it.  Documents come in
batches of descending doc_id.  A batch's lines become a sorted run of their own, which is
merge-anti-joined with every run so far: what is left are lines not seen before, and only
these bring a keeper; the others bring their count.  Then the batch adds its run.
Two runs of one level are merged into one of the next (counts added, keepers taken over),
so n batches leave at most log2(n) + 1 runs and a hash is rewritten log2(n) times.

All runs have as many buckets as a shuffle has partitions, so a batch's counts are written
as they leave their shuffle, and joins and merges read runs bucket by bucket without one.
Counting is a partial aggregate, so a line that a third of all documents hold is one row
of each task.  The lines of a document that are to go are found by a join with the runs'
frequent lines, and reach the document as one small row.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` around it, A-Z
lower-cased.  Keys of at least ``MIN_CHARS`` code points found in at least
``MIN_DOCUMENTS`` documents lose all their lines but those in the largest doc_id.

Defined results: a null or empty text is one empty line; every row is a document, also
repeated ones and those that share a doc_id (each counts, and the largest doc_id keeps its
lines in all its rows); no doc_id is below every doc_id; an empty table gives an empty
result.  Keys are compared by a 128-bit hash.
"""

from __future__ import annotations

import struct
import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialized_root
from .common import batches_of, record, slices, stored, texts

MIN_CHARS = 40
MIN_DOCUMENTS = 5
BATCHES = 4
KEY = ["h", "g"]              # the two halves of a line's hash
_SPACE = " \t\n\x0b\x0c\r"
_HALVES = "<qq"
_NO_ID = -(1 << 63)           # keeper where no document that holds the line has an id


def key_of(line: str, min_chars: int = MIN_CHARS) -> str | None:
    """The line's key; None where it is too short to count."""
    if len(line) < min_chars:
        return None
    key = line.strip(_SPACE)
    return key if len(key) >= min_chars else None


def _hashes(text: str, min_chars: int, digest) -> list[tuple[int, bytes]]:
    """(line number, hash) of the lines that count; bytes.lower() knows A-Z alone."""
    return [(i, digest(key.encode().lower())) for i, line in enumerate(text.split("\n"))
            if (key := key_of(line, min_chars)) is not None]


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key (tells the texts of one doc_id apart) and the distinct hashes of
    the lines that count, one row per document with any."""
    def run(batches):
        from xxhash import xxh3_128_digest
        for ids, keys, rows in batches_of(slices(batches, "text"), "doc_id", "text_key", "text"):
            found = [{h for _, h in _hashes(t, min_chars, xxh3_128_digest)} for t in rows]
            some = [i for i, x in enumerate(found) if x]
            halves = np.frombuffer(b"".join(h for i in some for h in found[i]), "<i8").reshape(-1, 2)
            ends = np.cumsum([0, *(len(found[i]) for i in some)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)], KEY))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.int64()),
                                              pa.array([keys[i] for i in some], pa.int64()), lists], ["doc_id", "text_key", "lines"])
    return texts(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(
        run, "doc_id long, text_key long, lines array<struct<h: long, g: long>>")


class LineRuns:
    """The runs of a corpus; tables of them lie below ``root`` in the shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.buckets = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = root or f"{materialized_root(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: dict[int, str] = {}  # one run at most on each level

    def _write(self, rows: DataFrame) -> str:
        """A run: bucketed and sorted by hash."""
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.select(*KEY, "n", "keeper").write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("compression", "zstd").option("path", f"{self.root}/{name}").saveAsTable(name))
        return name

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch (doc_id, h, g; one row for each document that holds the line) and
        return its lines that no run held before: h, g, n, keeper.  Batches come in
        descending order of doc_id."""
        own = lines.groupBy(*KEY).agg(F.count("*").alias("n"), F.coalesce(F.max("doc_id"), F.lit(_NO_ID)).alias("keeper"))
        held = F.lit(False)
        for k, name in self.levels.items():  # merge-anti-join; held lines stay for their count
            own = own.join(self.run(name).select(*KEY, F.lit(True).alias(f"in_{k}")), KEY, "left")
            held = held | F.col(f"in_{k}").isNotNull()
        name = self._write(own.withColumn("keeper", F.when(~held, F.col("keeper"))))
        fresh = self.run(name).where("keeper is not null")
        self._settle(name)
        return fresh

    def _settle(self, name: str, level: int = 0) -> None:
        while level in self.levels:
            other = self.levels.pop(level)
            merged = self._merged(other, name)
            self._drop(other, name)
            name, level = merged, level + 1
        self.levels[level] = name

    def _merged(self, left: str, right: str) -> str:
        """Two runs in one.  A line has a keeper in one of them at most."""
        a = self.run(left).select(*KEY, F.col("n").alias("n1"), F.col("keeper").alias("k1"))
        b = self.run(right).select(*KEY, F.col("n").alias("n2"), F.col("keeper").alias("k2"))
        none = F.lit(0).cast("long")
        return self._write(a.join(b, KEY, "full").select(
            *KEY, (F.coalesce("n1", none) + F.coalesce("n2", none)).alias("n"), F.coalesce("k1", "k2").alias("keeper")))

    def _drop(self, *names: str) -> None:
        """Forget runs that a merge replaced.  Their files stay until the application's folder is
        dropped, as rows that were handed out may still read them."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def compact(self) -> DataFrame:
        """All runs as one: h, g, n, keeper."""
        names = [self.levels.pop(k) for k in sorted(self.levels)]
        top = names[0] if names else None
        for name in names[1:]:
            top = self._merged(top, name)
        if top is None:
            return self.spark.createDataFrame([], "h long, g long, n long, keeper long")
        self.levels[len(names) + 32] = top
        return self.run(top)


def _batch_of(lowest, highest, batches: int):
    """Number of a document's batch: ranges of doc_id, the highest first; no doc_id is in the last."""
    if lowest is None:
        return F.lit(0)
    width = -(-(highest - lowest + 1) // batches)  # may pass a long, so in decimals
    place = (F.lit(Decimal(highest)) - F.col("doc_id")) / F.lit(Decimal(width))
    return F.coalesce(F.floor(place).cast("int"), F.lit(batches))


def frequent_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """h, g, keeper of the lines that enough documents hold; ``rows`` from ``line_hashes``."""
    spark = rows.sparkSession
    lowest, highest = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    path = f"{materialized_root(spark)}/line-batches-{uuid.uuid4().hex}"
    (rows.withColumn("batch", _batch_of(lowest, highest, batches)).select("batch", "doc_id", "lines")
     .write.partitionBy("batch").parquet(path))
    dealt = spark.read.schema("doc_id long, lines array<struct<h: long, g: long>>, batch int").parquet(path)
    runs = LineRuns(spark)
    for k in range(batches + 1):
        runs.add(dealt.where(F.col("batch") == k).select("doc_id", F.inline("lines")))
    # Written without buckets, so that a later join may split a line that very many documents hold.
    return stored(runs.compact().where(F.col("n") >= min_documents).select(*KEY, "keeper"), "line-frequent")


def dropped_lines(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """doc_id, text_key and the hashes of the lines that the document loses."""
    lines = rows.select("doc_id", "text_key", F.inline("lines"))
    return (lines.join(frequent, KEY).where(F.coalesce("doc_id", F.lit(_NO_ID)) != F.col("keeper"))
            .groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*KEY)).alias("lost")))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS,
                        batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_lines (before), n_dropped, text (what is kept)."""
    rows = stored(line_hashes(docs, min_chars), "line-hashes")
    lost = dropped_lines(rows, frequent_lines(rows, min_documents, batches))
    lost = lost.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})

    def run(batches_):
        from xxhash import xxh3_128_digest
        out = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])
        for ids, rows_, gone in batches_of(slices(batches_, "text"), "doc_id", "text", "lost"):
            n, kept, dropped = [], [], []
            for text, names in zip(rows_, gone):
                n.append(text.count("\n") + 1)
                lost_ = {struct.pack(_HALVES, x["h"], x["g"]) for x in names or ()}
                lines_ = {i for i, h in _hashes(text, min_chars, xxh3_128_digest) if h in lost_} if lost_ else ()
                dropped.append(len(lines_))
                kept.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in lines_) if lines_ else text)
            yield record(out, [ids, n, dropped, kept])

    d = texts(docs).withColumn("text_key", F.xxhash64("text"))
    return (d.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
            .select("doc_id", "text", "lost")
            .mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string"))


def digests(kept: DataFrame) -> DataFrame:
    """The digest columns of ``drop_repeated_lines``."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, row_number() OVER () AS k, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, k, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
y AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM y WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT k) >= 5),
j AS (SELECT y.*, f.key IS NOT NULL AND y.doc_id IS DISTINCT FROM f.keeper AS gone FROM y LEFT JOIN f ON f.key = y.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id, k
"""
