"""SpotSigs fingerprints (operator 5).

Anchors are the corpus's most common words.  From every anchor a chain of the
next content words (words that are no anchors) is formed; the distinct chains of a
text are its signatures, the fingerprint lists their 32-bit hashes in order.  A
text with words but no full chain takes the chain from its start.  Likeness of
two fingerprints is their Jaccard similarity; two empty ones are alike (1).

``similar_pairs`` compares the fingerprints of a collection: partitions by set
length (two sets whose sizes differ by more than the threshold allows cannot
match), an inverted index over the rarest signatures of each set, and exact
Jaccard on what remains.

Null text is empty text: no signature, an empty fingerprint.  Repeated rows
give repeated rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, record, texts

ANCHORS = 64    # most common words that serve as anchors
CHAIN = 2       # content words in a chain
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().lower().translate(_WORDS).split()


def common_words(docs: DataFrame, n: int = ANCHORS) -> list[bytes]:
    """The ``n`` most frequent words over all documents (ties by word)."""
    def count(batches):
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        c = Counter()
        for (rows,) in batches_of(batches, "text"):
            for t in rows:
                c.update(words(t))
            if len(c) > 500_000:
                yield record(schema, [list(c), list(c.values())])
                c.clear()
        yield record(schema, [list(c), list(c.values())])

    top = (texts(docs).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(n).collect())
    return [bytes(r["word"]) for r in top]


class _Codes(dict):
    """A 32-bit code for every word; 0 marks anchors."""

    def __init__(self, anchors):
        super().__init__((a, 0) for a in anchors)
        self.anchors = anchors

    def __missing__(self, w):
        c = self[w] = zlib.crc32(w) or 1
        return c

    def trim(self, most=1_000_000):
        if len(self) > most:
            self.clear()
            self.update((a, 0) for a in self.anchors)


def signatures(text: str, codes: _Codes, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint32)
    c = np.fromiter(map(codes.__getitem__, ws), np.uint64, len(ws))
    is_content = c != 0
    content = c[is_content]
    begin = np.cumsum(is_content)[~is_content]        # content words up to each anchor
    begin = begin[begin + chain <= len(content)]
    if not len(begin):
        begin, content = np.zeros(1, np.int64), np.concatenate([content if len(content) else c + np.uint64(7), np.zeros(chain, np.uint64)])
    h = np.full(len(begin), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(chain):
        h = (h ^ content[begin + k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return np.unique((h >> np.uint64(7)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text whose last third is replaced by as much of the start of the next."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows dealt by descending ranges of doc_id, each followed by the first row of
    the next range (``lead`` true), so that every row meets its successor."""
    rows = texts(docs)
    cuts = rows.select("doc_id").where("doc_id is not null").approxQuantile(
        "doc_id", [k / ranges for k in range(1, ranges)], 1e-3) if ranges > 1 else []
    cuts = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    # bucket 0 holds the largest ids; null ids come last
    above = F.size(F.filter(cuts, lambda c: c >= F.col("doc_id")))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(ranges + 1)).otherwise(above))
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # at most ranges + 1 rows
    heads = (rows.join(F.broadcast(tops.withColumnRenamed("bucket", "b")), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("top")))
             .groupBy("bucket").agg(F.min("text").alias("text")))
    order = Window.orderBy("bucket")
    moved = heads.select(F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))).alias("bucket"),
        F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("lead"))
    return (rows.withColumn("lead", F.lit(False)).unionByName(moved)
            .repartitionByRange(ranges, "bucket")
            .sortWithinPartitions("bucket", "lead", F.col("doc_id").desc_nulls_last(), "text"))


def fingerprints(docs: DataFrame, anchors: list[bytes], chain: int = CHAIN) -> DataFrame:
    """doc_id and fingerprint (hexadecimal, eight digits per signature) of every text."""
    def run(batches):
        codes = _Codes(anchors)
        schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
        for ids, rows in batches_of(batches, "doc_id", "text"):
            yield record(schema, [ids, [written(signatures(t, codes, chain)) for t in rows]])
            codes.trim()
    return texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame, anchors: list[bytes], ranges: int, chain: int = CHAIN) -> DataFrame:
    """Every document against its edited text and against the next document in
    descending doc_id order (after the last comes the first)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_signatures", pa.int64())])

    def run(batches):
        codes = _Codes(anchors)
        held = None  # the row that waits for its successor
        out = []
        for ids, rows, buckets, leads in batches_of(batches, "doc_id", "text", "bucket", "lead"):
            for row in zip(ids, rows, buckets, leads):
                sig = signatures(row[1], codes, chain)
                if held is not None and held[0][2] == row[2]:
                    (doc, text, _, _), own = held
                    other = edited(text, row[1])
                    esig = signatures(other, codes, chain)
                    out.append((doc, len(text), hashlib.sha256(other.encode()).hexdigest(), written(own), written(esig),
                                likeness(own, esig), likeness(own, sig), len(own)))
                held = None if row[3] else (row, sig)
                if len(out) >= 2000:
                    yield record(schema, list(zip(*out)))
                    out = []
            codes.trim()
        if out:
            yield record(schema, list(zip(*out)))

    return _in_order(docs, ranges).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, n_signatures long")


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (left < right) of distinct fingerprints with Jaccard of at least
    ``threshold``, as representatives' smallest doc_ids; ``prints``: doc_id, fingerprint.

    Equal fingerprints collapse first.  A set of size n matches only sizes
    n*t..n/t, so sets are dealt by geometric length partitions and meet their own
    and the adjacent one; inside, only sets that share one of their rarest
    n - ceil(t*n) + 1 signatures are compared."""
    import math
    sets = (prints.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
            .select("doc_id", F.expr("transform(sequence(1, length(fingerprint) div 8), i -> substring(fingerprint, (i - 1) * 8 + 1, 8))").alias("sigs")))
    sets = sets.withColumn("n", F.size("sigs"))
    sigs = sets.select("doc_id", "n", F.explode("sigs").alias("sig"))
    rarity = sigs.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = sigs.join(rarity, "sig").withColumn(
        "rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "sig")))
    need = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    part = F.floor(F.log(F.col("n")) / F.lit(-math.log(threshold) + 1e-12) + F.lit(1e-9))
    index = ranked.where(F.col("rank") <= need).select("doc_id", "n", "sig", part.alias("part"))
    probe = index.select(F.col("doc_id").alias("left_id"), F.col("n").alias("left_n"), "sig",
                         F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    pairs = (probe.join(index, ["sig", "part"]).where((F.col("left_id") < F.col("doc_id"))
             & (F.least("left_n", "n") >= F.greatest("left_n", "n") * (threshold - 1e-9)))
             .select("left_id", F.col("doc_id").alias("right_id")).distinct())
    both = (pairs.join(sets.select(F.col("doc_id").alias("left_id"), F.col("sigs").alias("a")), "left_id")
            .join(sets.select(F.col("doc_id").alias("right_id"), F.col("sigs").alias("b")), "right_id"))
    shared = F.size(F.array_intersect("a", "b"))
    j = shared / (F.size("a") + F.size("b") - shared)
    return both.select("left_id", "right_id", j.alias("similarity")).where(F.col("similarity") >= threshold)
