"""Benchmark decontamination by a prefix-filtered set join (operator 4).

Only DataFrame functions.  An item's windows are ``window`` consecutive words (a
shorter item is one window).  Shingles of two words (one word for a one-word
window) are ordered by rarity in the documents; since a window counts only if
all of it occurs, its necessary prefix is its single rarest shingle.

1. Documents' shingles (as 64-bit hashes, with positions) meet the windows'
   shingles; the hits are written once.
2. Hits give every shingle's frequency, which picks each window's prefix shingle.
3. Hits of prefix shingles are candidates; the shingle's place in the window
   gives the start, which must lie in the document with the whole window
   (position and length bounds).
4. Candidate documents are read again; the words at each candidate start must
   equal the window's words.

Null texts have no words, so neither windows nor hits.  Items without an id are
ignored; several rows of one item add up.  Repeated documents give repeated rows.
An empty table gives an empty result.  The benchmark's shingles are broadcast only up
to ``BROADCAST_ROWS`` rows; beyond, the join is shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored

WINDOW = 13
BROADCAST_ROWS = 1_000_000  # pairs of numbers
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and characters beyond ASCII (null: none)."""
    return F.array_remove(F.split(lowered(F.coalesce(text.cast("string"), F.lit(""))), _GAP), "")


def _shingles(ws: Column, width: int) -> Column:
    """Hashes of ``width`` consecutive words."""
    if width == 1:
        return F.transform(ws, lambda w: F.xxhash64(w))
    return F.transform(F.arrays_zip(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))).alias("a"),
                                    F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))).alias("b")),
                       lambda p: F.xxhash64(p["a"], p["b"]))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, window_text (words joined by spaces), len and ws of every distinct window."""
    ws = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    n = F.greatest(F.size("ws") - window, F.lit(0))
    return (ws.select("item_id", "ws", F.explode(F.sequence(F.lit(1), n + 1)).alias("at"))
            .select("item_id", F.slice("ws", F.col("at"), F.lit(window)).alias("ws"))
            .select("item_id", "ws", F.array_join("ws", " ").alias("window_text"), F.size("ws").alias("len")).distinct())


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return _judged(docs, items, window, percent).drop("th")


def _judged(docs: DataFrame, items: DataFrame, window: int, percent: int) -> DataFrame:
    """The columns of ``contamination`` and ``th``, the hash of the row's text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = [F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")]
    windows = stored(item_windows(items, window), "windows")
    distinct = windows.select("window_text", "ws", "len").distinct()
    placed = stored(distinct.select("window_text", "len", F.posexplode(
        F.when(F.col("len") == 1, _shingles(F.col("ws"), 1)).otherwise(_shingles(F.col("ws"), 2))).alias("place", "h")), "window-shingles")
    singles = placed.where("len = 1").limit(1).count() > 0  # one-word windows need the documents' single words too
    sought = placed.select("h").distinct()
    n_sought = sought.count()

    ws = source.select(*key, words(F.col("text")).alias("ws"))
    both = F.concat(F.array(F.lit(None).cast("long")), _shingles(F.col("ws"), 2))
    spots = ws.select("id", "th", F.size("ws").alias("n_words"), F.posexplode(both).alias("pos", "h"))
    if singles:
        spots = spots.union(ws.select("id", "th", F.size("ws").alias("n_words"), F.posexplode(_shingles(F.col("ws"), 1)).alias("pos", "h"))
                            .withColumn("pos", F.col("pos") + 1))
    # the null shingle stays: one row for each document, with its number of words
    hits = stored(spots.join(broadcast_if_small(sought.withColumnRenamed("h", "sought"), n_sought, BROADCAST_ROWS),
                             F.col("h") == F.col("sought"), "left").where("sought is not null or h is null")
                  .select("id", "th", "n_words", (F.col("pos") - 1).alias("pos"), "h"), "shingle-hits")

    rarity = hits.where("h is not null").groupBy("h").agg(F.count("*").alias("df"))
    ranked = placed.join(rarity, "h", "left").select(
        "window_text", "len", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "place").alias("r"))
    prefix = ranked.groupBy("window_text", "len").agg(F.min("r").alias("r")).where("r.df > 0")
    anchors = stored(prefix.select(F.col("r.h").alias("h"), F.col("r.place").alias("place"), "len").distinct(), "prefixes")
    starts = (hits.where("h is not null").join(broadcast_if_small(anchors, anchors.count(), BROADCAST_ROWS), "h")
              .select("id", "th", (F.col("pos") - F.col("place")).alias("start"), "len", "n_words")
              .where("start >= 0 and start + len <= n_words").select("id", "th", "start", "len").distinct()
              .groupBy("id", "th").agg(F.collect_list(F.struct("start", "len")).alias("starts")))  # at most one list entry per word and length

    starts = stored(starts.withColumnRenamed("id", "i").withColumnRenamed("th", "t"), "starts")
    of_start = F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))
    narrowed = source.select(*key, "text").join(
        broadcast_if_small(starts.select("i", "t"), starts.count(), BROADCAST_ROWS), of_start, "left_semi")
    found = (narrowed.dropDuplicates(["id", "th"]).join(starts, of_start)
             .select("id", "th", words(F.col("text")).alias("ws"), "starts")
             .select("id", "th", F.explode(F.transform("starts", lambda x: F.struct(
                 x["start"].alias("start"), x["len"].alias("len"),
                 F.array_join(F.slice(F.col("ws"), x["start"] + 1, x["len"]), " ").alias("window_text")))).alias("x"))
             .select("id", "th", "x.start", "x.len", "x.window_text"))
    found = stored(found.join(distinct.select("window_text"), "window_text", "left_semi"), "windows-found")

    # words covered: what each window adds beyond the furthest end before it
    before = Window.partitionBy("id", "th").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    covered = (found.select("id", "th", "start", "len").distinct()
               .withColumn("reached", F.coalesce(F.max(end).over(before), F.lit(0)))
               .groupBy("id", "th").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reached"))).alias("n_hit")))
    named = (found.select("id", "th", "window_text").distinct().join(windows.select("window_text", "item_id"), "window_text")
             .select("id", "th", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("id", "th").agg(F.array_sort(F.collect_list("item")).alias("items")))

    def beside(left, right):
        right = right.withColumnRenamed("id", "i").withColumnRenamed("th", "t")
        return left.join(right, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left").drop("i", "t")

    sizes = hits.where("h is null").select("id", "th", "n_words")  # one row for each row of documents
    out = beside(beside(sizes, covered), named)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias("doc_id"), "th", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                      F.size(items_found).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
                      ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; each is judged by its own text,
    also without doc_id or with one that other texts share."""
    bad = (_judged(docs, items, window, percent).where("contaminated")
           .select(F.col("doc_id").alias("_bad_id"), F.col("th").alias("_bad_text")).distinct())
    own = docs["doc_id"].cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_bad_text"))
    return docs.join(bad, own, "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[a:a + 12], ' ') AS t
    FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS a FROM i WHERE len(ws) > 0)),
p AS (SELECT k, n, a, array_to_string(ws[a:a + n - 1], ' ') AS t FROM (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS a
    FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
m AS (SELECT p.k, p.a, p.n, w.item_id FROM p JOIN w ON p.t = w.t),
c AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(a, a + n)) AS x FROM m) GROUP BY k),
s AS (SELECT k, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS t FROM m) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN s USING (k)
"""
