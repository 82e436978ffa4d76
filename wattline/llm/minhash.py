"""Near-duplicates by b-bit MinHash (operator 8).

A document's set is its distinct word shingles.  Equal sets collapse to one class
(its smallest doc_id stands for it).  For each class ``K`` minima are drawn; the
first ``BANDS * ROWS`` of them form bands, and of all of them only the low ``BITS``
bits are kept, packed.  Two sets are candidates when a band agrees; the packed
signatures are compared by bit counts, corrected for chance collisions, and
candidates clearly below the threshold go.  What remains is confirmed on the
full sets.

Large groups never become rows of pairs:

1. Inside every band bucket (large ones in blocks of bounded size) the estimates
   join members to regions; a spanning forest of them is all that leaves the task.
2. Regions are cut into blocks; two blocks meet in one task, which compares the full
   sets of promising pairs that nothing has linked yet, and again only a spanning
   forest of the confirmed links leaves.  No member is left out.

At the threshold 0.8 a linked pair shares no band with probability below 4e-6.
The result's components are those of the graph of all confirmed links.

Null and empty texts have no set and are linked with nothing.  Rows without
doc_id get no component and are kept.  Repeated rows give repeated rows; a doc_id
that occurs with several texts gets a row for each.  An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, broadcast_if_small, record, stored, texts
from .components import components

BANDS, ROWS = 32, 5
K = 256            # minima in all; the first BANDS * ROWS serve as bands too
BITS = 4
BLOCK = 1024              # classes in a block
BROADCAST_IDS = 4_000_000   # numbers of documents to broadcast; more are joined by a shuffle
BLOCK_SHINGLES = 1_000_000  # shingles in a block of full sets, about
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _Hashes(dict):
    def __missing__(self, word):
        from xxhash import xxh3_64_intdigest
        h = self[word] = xxh3_64_intdigest(word)
        return h


def shingle_set(text: str, size: int, hashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words (a shorter text
    is one shingle, a text without words has none)."""
    ws = text.encode().lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - size + 1)
    width = min(size, len(h))
    s = h[:n].copy()
    for k in range(1, width):
        s = (s ^ (s >> np.uint64(29))) * _MIX + h[k:k + n]
    s = (s ^ (s >> np.uint64(31))) * _MIX
    if width < size:
        s ^= np.uint64(width)
    return np.unique(s)


def _constants():
    rng = np.random.default_rng(5)
    return (rng.integers(0, 1 << 32, K, np.uint64) | np.uint64(1)).astype(np.uint32), rng.integers(0, 1 << 32, K, np.uint64).astype(np.uint32)


def minima(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """K minima (K x sets) of concatenated non-empty sets of 64-bit hashes."""
    x = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    a, b = _constants()
    out, y = np.empty((K, len(starts)), np.uint32), np.empty_like(x)
    for k in range(K):
        np.multiply(x, a[k], out=y)
        np.add(y, b[k], out=y)
        out[k] = np.minimum.reduceat(y, starts)
    return out


def pack(mins: np.ndarray) -> np.ndarray:
    """Low bits of the minima, two to a byte: sets x K/2 bytes."""
    low = (mins.T & np.uint32(15)).astype(np.uint8)
    return np.ascontiguousarray(low[:, 0::2] | (low[:, 1::2] << 4))


def band_keys(mins: np.ndarray) -> np.ndarray:
    """BANDS x sets 64-bit keys."""
    out = np.empty((BANDS, mins.shape[1]), np.uint64)
    for j in range(BANDS):
        h = np.full(mins.shape[1], (j + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for r in range(ROWS):
            h = (h ^ mins[j * ROWS + r]) * _MIX
            h ^= h >> np.uint64(32)
        out[j] = h
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (rows of uint64 words)."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)
    chance = 1.0 / (1 << BITS)
    return ((1 - differ / K) - chance) / (1 - chance)


def cut_for(threshold: float) -> float:
    """Estimates below this are 4.5 standard deviations under the threshold."""
    p = threshold + (1 - threshold) / (1 << BITS)
    return threshold - 4.5 * (p * (1 - p) / K) ** 0.5 / (1 - 1.0 / (1 << BITS))


def _sign(size: int):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                            ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])
        from xxhash import xxh3_128_digest
        hashes = _Hashes()
        for ids, rows in batches_of(batches, "doc_id", "text"):
            a = 0
            while a < len(rows):
                sets, total = [], 0
                while a < len(rows) and total < 60_000:
                    sets.append(shingle_set(rows[a], size, hashes))
                    total += len(sets[-1])
                    a += 1
                n = np.array([len(s) for s in sets])
                some = np.flatnonzero(n)
                sig, keys, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if len(some):
                    full = [sets[i] for i in some]
                    mins = minima(np.concatenate(full), np.cumsum(n[some]) - n[some])
                    packed, band = pack(mins), np.ascontiguousarray(band_keys(mins).T)
                    for j, i in enumerate(some):
                        sig[i], bands[i], keys[i] = packed[j].tobytes(), band[j].view(np.int64), xxh3_128_digest(sets[i].tobytes())
                yield record(schema, [ids[a - len(sets):a], n, keys, sig, bands])
            if len(hashes) > 1_000_000:
                hashes.clear()
    return run


def _words(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), -1)


def _blocks(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Deal the rows of each group to units (group, i, j) of two of its blocks; every
    two rows of a group meet in a unit."""
    rows = rows.withColumn("_t", blocks).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_t")).cast("int"))
    units = F.expr("transform(sequence(0, _t - 1), k -> struct(least(k, _own) as i, greatest(k, _own) as j))")
    return (rows.withColumn("_u", F.explode(units)).withColumn("i", F.col("_u.i")).withColumn("j", F.col("_u.j"))
            .drop("_t", "_own", "_u").repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "rep"))


def _forest(n: int, linked) -> list[tuple[int, int]]:
    """Spanning forest of positions 0..n-1; ``linked(i, others)`` masks those joined to i."""
    out, fresh = [], np.arange(n)
    while len(fresh):
        todo, fresh = [fresh[0]], fresh[1:]
        while todo and len(fresh):
            i = todo.pop()
            hit = linked(i, fresh)
            todo += fresh[hit].tolist()
            out += [(i, k) for k in fresh[hit]]
            fresh = fresh[~hit]
    return out


def _units(batches, columns, edges_of):
    """Edges (a, b) of every unit of consecutive equal first three columns."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    unit, rows, out = None, [], []
    for batch in batches_of(batches, *columns):
        for r in zip(*batch):
            if r[:3] != unit:
                out += edges_of(rows)
                unit, rows = r[:3], []
            rows.append(r[3:])
        yield record(schema, [[min(x) for x in out], [max(x) for x in out]])
        out = []
    out += edges_of(rows)
    yield record(schema, [[min(x) for x in out], [max(x) for x in out]])


def _regions(cut: float):
    """Pairs that share a bucket and whose estimate reaches ``cut``: a spanning forest of each unit."""
    def edges_of(rows):
        if len(rows) < 2:
            return []
        sig = _words([r[1] for r in rows])
        return [(rows[i][0], rows[k][0]) for i, k in _forest(len(rows), lambda i, others: estimate(sig[others], sig[i]) >= cut)]
    return lambda batches: _units(batches, ("key", "i", "j", "rep", "sig"), edges_of)


def _confirmed(cut: float, percent: int):
    """Pairs of a region whose full sets reach the threshold: a spanning forest of each unit."""
    def edges_of(rows):
        if len(rows) < 2:
            return []
        sig, sets = _words([r[1] for r in rows]), [np.frombuffer(r[2], "<u8") for r in rows]
        n = np.array([len(s) for s in sets])
        starts = np.cumsum(n) - n
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(flat.max() + 1, bool)

        def linked(i, others):
            out = np.zeros(len(others), bool)
            some = np.flatnonzero((estimate(sig[others], sig[i]) >= cut) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])))
            if len(some):
                own = flat[starts[i]:starts[i] + n[i]]
                mark[own] = True
                for k in some:
                    o = others[k]
                    both = int(np.count_nonzero(mark[flat[starts[o]:starts[o] + n[o]]]))
                    out[k] = 100 * both >= percent * (n[i] + n[o] - both)
                mark[own] = False
            return out
        return [(rows[i][0], rows[k][0]) for i, k in _forest(len(rows), linked)]
    return lambda batches: _units(batches, ("region", "i", "j", "rep", "sig", "set"), edges_of)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """rep, sig, set of the classes in ``wanted`` (rep, set_key, ...), from the representatives' texts."""
    def sets(batches):
        from xxhash import xxh3_128_digest
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("set", pa.binary())])
        hashes = _Hashes()
        for ids, rows in batches_of(batches, "doc_id", "text"):
            for a in range(0, len(ids), 500):
                s = [shingle_set(t, size, hashes) for t in rows[a:a + 500]]
                yield record(schema, [ids[a:a + 500], [xxh3_128_digest(x.tobytes()) for x in s], [x.astype("<u8").tobytes() for x in s]])
            if len(hashes) > 1_000_000:
                hashes.clear()

    ids = broadcast_if_small(wanted.select("rep"), wanted.count(), BROADCAST_IDS)
    full = (texts(docs).join(ids, F.col("doc_id") == F.col("rep"), "left_semi")
            .mapInArrow(sets, "doc_id long, key binary, set binary"))
    # rows that repeat a representative give equal sets: they link to themselves, which changes nothing
    return full.join(wanted, (F.col("doc_id") == F.col("rep")) & (F.col("key") == F.col("set_key"))).drop("doc_id", "key", "set_key")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    cut = cut_for(percent / 100)
    signed = stored(texts(docs).mapInArrow(_sign(size), "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>"), "minhash")
    classes = stored(signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
                     .agg(F.min(F.struct("doc_id", "sig", "bands", "n_shingles")).alias("m"))
                     .select("set_key", F.col("m.doc_id").alias("rep"), "m.sig", "m.bands", "m.n_shingles"), "minhash-classes")
    band = classes.select("rep", F.explode("bands").alias("key"))
    shared = band.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stored(band.join(shared, "key").select("key", "rep", "n"), "minhash-buckets")

    near = _blocks(buckets.join(classes.select("rep", "sig"), "rep"), "key", F.ceil(F.col("n") / BLOCK).cast("int"))
    regions = stored(components(near.select("key", "i", "j", "rep", "sig").mapInArrow(_regions(cut), "a long, b long")), "minhash-regions")
    members = stored(classes.join(regions, F.col("rep") == F.col("node")).select(
        "rep", "set_key", "sig", "n_shingles", F.col("component").alias("region")), "minhash-members")
    sizes = members.groupBy("region").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("t"))
    met = _blocks(_sets(docs, members.drop("n_shingles").join(sizes, "region"), size), "region", F.col("t"))
    top = components(met.select("region", "i", "j", "rep", "sig", "set").mapInArrow(_confirmed(cut, percent), "a long, b long"))

    of_rep = (classes.select("set_key", "rep").join(top, F.col("rep") == F.col("node"), "left")
              .select("set_key", F.coalesce("component", "rep").alias("component_id")))
    return (signed.select("doc_id", "n_shingles", "set_key").join(of_rep, "set_key", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: the smallest doc_id
    (ties: one text of it) and, beside it, one of the rows without doc_id.  Rows are known by doc_id
    and text, so unlike texts of one doc_id, or without doc_id, are judged apart.  Of exact
    copies (same doc_id and text) one stays; rows without doc_id and without words all stay."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = stored(near_duplicates(docs.select(key.alias("doc_id"), "text"), size, percent)
                  .groupBy(F.col("doc_id").alias("_key"))
                  .agg(F.min("component_id").alias("group"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("_copies")),
                  "minhash-rows")
    ids = docs.select(key.alias("_key"), F.col("doc_id").cast("long").alias("id")).distinct()
    named = rows.join(ids, "_key")
    first = named.groupBy("group", F.col("id").isNull().alias("lost")).agg(F.min(F.struct("id", "_key")).alias("m"))
    kept = stored(first.select(F.col("m._key").alias("_key")).distinct().join(rows, "_key").join(
        ids.where("id is null").select("_key", F.lit(True).alias("lost")), "_key", "left")
        .select("_key", ((F.col("_copies") > 1) & ~(F.coalesce("lost", F.lit(False)) & (F.col("n_shingles") == 0))).alias("_repeated")),
        "minhash-kept")
    keyed = docs.withColumn("_key", key)
    once = keyed.join(kept.where("not _repeated"), "_key", "left_semi")
    again = keyed.join(kept.where("_repeated"), "_key", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*docs.columns)
