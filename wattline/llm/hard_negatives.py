"""Hard-negative mining with rotated one-bit codes (operator 11).

Every vector is turned by one fixed orthogonal rotation (random signs and a Hadamard
transform, twice) and kept as the signs of its coordinates, its norm, and its alignment:
the inner product with its own code, taken as a unit vector.  For an anchor q and a vector
v with code c, both turned, v = a c + r with r orthogonal to c, so

    <q, v> = a <q, c> + <q, r>   and   |<q, r>| <= sqrt(|q|^2 - <q, c>^2) |r|

by Cauchy-Schwarz.  <q, c> comes from popcounts of the code against the bit planes of the
anchor's coordinates, which are rounded to ``PLANES`` bits; the rounding error is known and
widens the interval.  A pair whose whole interval lies outside what the search still needs
is dropped; all others get their exact integer inner product.  The interval always holds
the true score, so nothing is missed: the answers equal those of scoring every pair.

Work is dealt in a grid.  Vectors are stored once in chunks of ``CHUNK`` rows with their
codes, anchors (the stated query set) in blocks of ``ANCHORS``.  Every cell of the grid gets a
share of the chunks and a share of the blocks, so a chunk travels once for each column of the
grid, a block once for each row, and every chunk meets every block once for the positives and
once for the negatives.  Nothing is broadcast or sent to the driver for it: a task takes in its
cell's blocks (``_HELD`` anchors at most), then its chunks one by one, keeps the best few rows
of each anchor and passes them on.  What is shuffled grows with rows, anchors and the sides of
the grid, not with pairs.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite
component (also after scaling), take no part.  Vectors are compared with those of their own length.  A row with
the anchor's vec_id is the anchor itself; a vec_id that occurs several times is taken with
its best-scoring row for each anchor and use; repeated equal anchors count once.  Inner
products beyond a long are cut to its range.  Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOWEST, HIGHEST = 50, 95     # a negative's score as percent of the positive's
CHUNK = 512
ANCHORS = 1024
PLANES = 6
_HELD = 32 * ANCHORS         # anchors of a cell, about
_TILE = 128                  # anchors that meet a chunk at once
_DENSE = 24                  # when more than one of so many pairs is left, all are multiplied
_SMALL = 1 << 25             # components below this are multiplied as longs
_WHOLE = {np.float32: 1 << 24, np.float64: 1 << 53}  # whole numbers below this are exact
_LONG = (1 << 63) - 1
_SLACK = 1e-6                # of the norms' product: float rounding in the bounds


# -- codes -----------------------------------------------------------------

def rotate(v: np.ndarray) -> np.ndarray:
    """Rows turned by the fixed rotation, padded with zeros to a power of two."""
    width = 1 << max(6, int(v.shape[1] - 1).bit_length())
    x = np.zeros((len(v), width))
    x[:, :v.shape[1]] = v
    rng = np.random.default_rng(17)
    for _ in range(2):
        x *= rng.integers(0, 2, width) * 2 - 1
        step = 1
        while step < width:
            y = x.reshape(len(x), -1, 2, step)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), width)
            step *= 2
        x /= np.sqrt(width)
    return x


def encode(v: np.ndarray):
    """(codes as 64-bit words, alignment, norm of the remainder, norm) of integer rows."""
    x = rotate(v.astype(float))
    norm = np.sqrt((x * x).sum(1))
    codes = np.packbits(x > 0, axis=1, bitorder="little").view(np.uint64)
    align = np.abs(x).sum(1) / np.sqrt(x.shape[1])
    return codes, align, np.sqrt(np.maximum(norm * norm - align * align, 0.0)), norm


def planes(q: np.ndarray):
    """Anchors prepared for popcounts: bit planes (plane, anchor, word), step, lowest value and
    total of the rounded coordinates, a bound of the rounding error of <q, c>, and the norm."""
    x = rotate(q.astype(float))
    width = x.shape[1]
    low = x.min(1)
    step = np.maximum((x.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((x - low[:, None]) / step[:, None]).astype(np.uint8)
    error = np.abs(low[:, None] + level * step[:, None] - x).sum(1) / np.sqrt(width)
    bits = np.stack([np.packbits((level >> k) & 1, axis=1, bitorder="little").view(np.uint64) for k in range(PLANES)])
    total = width * low + level.sum(1, dtype=np.int64) * step
    return bits, step, low, total, error, np.sqrt((x * x).sum(1)), width


def _space(room: dict, name: str, shape: tuple[int, int], kind=float) -> np.ndarray:
    """An array to write to that is used again by the next call: fresh memory costs more than the work on it."""
    n = shape[0] * shape[1]
    if name not in room or room[name].size < n or room[name].dtype != kind:
        room[name] = np.empty(n, kind)
    return room[name][:n].reshape(shape)


def intervals(anchors, codes, align, rest, norm, room: dict | None = None):
    """Lowest and highest possible inner product of every anchor with every coded row; with
    ``room`` they last until the next call that is given it."""
    bits, step, low, total, error, size, width = anchors
    room, shape = {} if room is None else room, (bits.shape[1], len(codes))
    both, count = _space(room, "both", shape, np.uint64), _space(room, "count", shape, np.uint8)
    weighted = _space(room, "weighted", shape, np.uint16 if width << PLANES < 1 << 16 else np.int64)
    weighted[:] = 0
    for k in reversed(range(PLANES)):
        weighted <<= 1
        for w in range(codes.shape[1]):
            np.bitwise_and(bits[k][:, w, None], codes[:, w], out=both)
            weighted += np.bitwise_count(both, out=count)
    # s = (2 * up - total) / sqrt(width); up: the coordinates where the code is +1
    ones = np.bitwise_count(codes).sum(1, dtype=float)
    s, half, more = (_space(room, x, shape) for x in ("s", "half", "more"))
    np.multiply(weighted, (2 * step / np.sqrt(width))[:, None], out=s)
    s += np.matmul(np.stack([2 * low, -total], 1) / np.sqrt(width), np.stack([ones, np.ones(len(ones))]), out=more)
    error = error + _SLACK * size
    np.abs(s, out=half)
    half -= error[:, None]
    np.maximum(half, 0.0, out=half)
    half *= half
    np.subtract((size * size * (1 + _SLACK))[:, None], half, out=half)
    np.maximum(half, 0.0, out=half)
    np.sqrt(half, out=half)
    half *= rest
    half += np.matmul(np.stack([error, _SLACK * size], 1), np.stack([align, norm]), out=more)
    s *= align
    return np.subtract(s, half, out=more), np.add(s, half, out=s)


def exact(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the named pairs of rows."""
    out = np.empty(len(i), np.int64)
    wide = q.dtype == object or v.dtype == object
    for a in range(0, len(i), 1 << 16):
        part = slice(a, a + (1 << 16))
        if wide:
            out[part] = [max(-_LONG, min(_LONG, sum(x * y for x, y in zip(q[k].tolist(), v[m].tolist()))))
                         for k, m in zip(i[part], j[part])]
        else:
            out[part] = np.einsum("ij,ij->i", q[i[part]], v[j[part]])
    return out


# -- tables ----------------------------------------------------------------

def prepared(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and ``v`` (array of doubles that hold integers) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                          F.transform(F.col(vector).cast("array<double>"), lambda x: x * SCALE).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh vec_id takes the next label of ten."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def _alike(batches, lists: tuple[int, ...], size: int):
    """Rows regrouped by the lengths of the columns ``lists``: the lengths and at most ``size``
    rows, column by column, lists as matrices."""
    waiting: dict[tuple, list] = {}

    def joined(parts):
        return [np.concatenate(x) for x in zip(*parts)]

    for b in batches:
        if not b.num_rows:
            continue
        lengths = np.stack([pc.list_value_length(b.column(k)).to_numpy(zero_copy_only=False) for k in lists], 1)
        kinds, which = np.unique(lengths, axis=0, return_inverse=True)
        for n, kind in enumerate(map(tuple, kinds.tolist())):
            at = np.flatnonzero(which.ravel() == n)
            rows = b if len(kinds) == 1 else b.take(pa.array(at))
            columns = [rows.column(k).to_numpy(zero_copy_only=False) if k not in lists else
                       rows.column(k).flatten().to_numpy(zero_copy_only=False).reshape(len(at), kind[lists.index(k)])
                       for k in range(b.num_columns)]
            mine = waiting.setdefault(kind, [])
            mine.append(columns)
            if sum(len(x[0]) for x in mine) >= size:
                columns = joined(mine)
                full = len(columns[0]) // size * size
                for a in range(0, full, size):
                    yield kind, [x[a:a + size] for x in columns]
                waiting[kind] = [[x[full:] for x in columns]]
    for kind, mine in waiting.items():
        columns = joined(mine)
        if len(columns[0]):
            yield kind, columns


def _packed(ints: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them all."""
    most = np.abs(ints).max(initial=0.0)
    return ints.astype(next((x for x in ("<i2", "<i4") if most <= np.iinfo(x).max), "<f8")).tobytes()


def _ints(data: bytes, n: int, dim: int) -> np.ndarray:
    """Packed rows as longs, or as Python integers where products could pass a long."""
    rows = np.frombuffer(data, {2: "<i2", 4: "<i4", 8: "<f8"}[len(data) // (n * dim)] if n * dim else "<i2").reshape(n, dim)
    if not rows.size or np.abs(rows.astype(float)).max() < _SMALL:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in r] for r in rows.tolist()], object).reshape(rows.shape)


_CHUNK_COLUMNS = "number long, dim int, rows int, ids binary, labels binary, ints binary, codes binary, bounds binary"
_BLOCK_COLUMNS = ("number long, dim int, rows int, ids binary, labels binary, ints binary, anchors binary, low binary, "
                  "high binary, wanted int")


def _table_row(columns: str, values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in columns.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x], kinds[t])
                                       for x, t in zip(values, types)], list(names))


def _chunks(size: int):
    """Rows (vec_id, label, v) into chunks of one vector length, with codes; one row per chunk."""
    def run(batches):
        from pyspark import TaskContext
        made = TaskContext.get().partitionId() << 32
        for (dim,), (ids, labels, v) in _alike(batches, (2,), size):
            made += 1
            ints = np.floor(v)
            codes, align, rest, norm = encode(ints)
            yield _table_row(_CHUNK_COLUMNS, (made, dim, len(ids), ids, labels, _packed(ints), codes, np.stack([align, rest, norm])))
    return run


def chunks_of(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    return rows.select("vec_id", "label", "v").mapInArrow(_chunks(size), _CHUNK_COLUMNS)


def _blocks(batches):
    """Anchors (anchor, vec_id, label, v, low, high) into blocks of one vector length."""
    from pyspark import TaskContext
    made = TaskContext.get().partitionId() << 32
    for (dim, wanted, _), (anchors, ids, labels, v, low, high) in _alike(batches, (3, 4, 5), ANCHORS):
        made += 1
        yield _table_row(_BLOCK_COLUMNS, (made, dim, len(ids), ids, labels, _packed(np.floor(v)), anchors, low, high, wanted))


class _Best:
    """The best ``keep`` (score, id) of every (anchor, window) of a cell's anchors, best first."""

    def __init__(self, n: int, keep: int):
        self.keep, self.count = keep, np.zeros(n, np.int64)
        self.score, self.ids = np.zeros((n, keep), np.int64), np.zeros((n, keep), np.int64)
        self.floor = np.full(n, -np.inf)  # a score below this no longer counts

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(slot)
        held = np.arange(self.keep) < self.count[touched][:, None]
        slot = np.concatenate([slot, np.repeat(touched, self.count[touched])])
        score = np.concatenate([score, self.score[touched][held]])
        ids = np.concatenate([ids, self.ids[touched][held]])
        order = np.lexsort((-score, ids, slot))  # an id counts once, with its best score
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.append(True, (slot[1:] != slot[:-1]) | (ids[1:] != ids[:-1]))
        slot, score, ids = slot[first], score[first], ids[first]
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        sizes = np.diff(np.append(begins, len(slot)))
        rank = np.arange(len(slot)) - np.repeat(begins, sizes)
        best = rank < self.keep
        slot, score, ids, rank = slot[best], score[best], ids[best], rank[best]
        self.score[slot, rank], self.ids[slot, rank] = score, ids
        self.count[touched] = np.minimum(sizes, self.keep)
        last = rank == self.keep - 1
        self.floor[slot[last]] = score[last]


class _Anchors:
    """A cell's anchors of one vector length and number of windows, by label, and their best rows."""

    def __init__(self, dim: int, wanted: int, blocks: list[dict], keep: int):
        long = lambda name: np.concatenate([np.frombuffer(b[name], np.int64) for b in blocks])
        labels = long("labels")
        order = np.argsort(labels, kind="stable")
        self.wanted, self.labels, self.ids, self.names = wanted, labels[order], long("ids")[order], long("anchors")[order]
        self.low, self.high = long("low").reshape(-1, wanted)[order], long("high").reshape(-1, wanted)[order]
        self.best = _Best(len(order) * wanted, keep)
        ints = [_ints(b["ints"], b["rows"], dim) for b in blocks]
        q = np.concatenate([x.astype(object) for x in ints] if any(x.dtype == object for x in ints) else ints)[order]
        self.tiles, self.room = [], {}
        for a in range(0, len(order), _TILE):
            part = q[a:a + _TILE]
            if part.dtype == object and all(abs(x) < _SMALL for r in part.tolist() for x in r):
                part = part.astype(np.int64)
            self.tiles.append((a, part, _floats(part), planes(part)))

    def meet(self, chunk: dict, same: bool) -> None:
        for tile in self.tiles:
            labels, part = self.labels[tile[0]:tile[0] + _TILE], chunk
            if same:
                at = np.flatnonzero(np.isin(chunk["labels"], labels))
                if not len(at):
                    continue
                part = {k: x[at] if isinstance(x, np.ndarray) else x and [(y[at], most) for y, most in x] for k, x in chunk.items()}
            self._meet(*tile, part, same)

    def _meet(self, a: int, q: np.ndarray, q_floats, ready, chunk: dict, same: bool) -> None:
        part, wanted, best, v = slice(a, a + len(q)), self.wanted, self.best, chunk["ints"]
        low, high = self.low[part], self.high[part]

        def floor():  # of what a window of an anchor may still take
            return np.maximum(best.floor.reshape(-1, wanted)[part], low)

        def take(i, j, score):
            least, slots, at = floor(), [], []
            for w in range(wanted):
                fits = np.flatnonzero((score >= least[i, w]) & (score >= low[i, w]) & (score <= high[i, w]))
                slots.append((i[fits] + a) * wanted + w)
                at.append(fits)
            at = np.concatenate(at)
            if len(at):
                best.add(np.concatenate(slots), score[at], chunk["ids"][j[at]])

        lowest, highest = intervals(ready, chunk["codes"], *chunk["bounds"].T, self.room)
        able = (chunk["labels"] == self.labels[part][:, None]) == same
        able &= chunk["ids"] != self.ids[part][:, None]
        least, most = floor().min(1)[:, None], high.max(1)[:, None]
        able &= highest >= least
        able &= lowest <= most
        left = np.count_nonzero(able)
        q_floats, v_floats = q_floats or [], chunk["floats"] or []
        for kind, (x, x_most), (y, y_most) in zip(_WHOLE, q_floats, v_floats) if left * _DENSE > able.size else ():
            if x_most * y_most * 1.001 >= _WHOLE[kind]:  # a partial sum may not be exact
                continue
            # Much is left: all products at once.
            score = np.matmul(x, y.T, out=_space(self.room, str(kind), able.shape, x.dtype))
            able &= score >= least.astype(kind)
            able &= score <= most.astype(kind)
            i, j = np.nonzero(able)
            if len(i):
                take(i, j, score[i, j].astype(np.int64))
            return
        if not left:
            return
        # The likeliest first: they raise the floor for the rest.
        some = min(best.keep, able.shape[1])
        first = np.argpartition(np.where(able, lowest, -np.inf), -some, 1)[:, -some:]
        lead = np.zeros_like(able)
        np.put_along_axis(lead, first, True, 1)
        lead &= able
        for rest in (False, True):
            if rest:
                able &= ~lead & (highest >= floor().min(1)[:, None])
            i, j = np.nonzero(able if rest else lead)
            if len(i):
                take(i, j, exact(q, v, i, j))

    def found(self):
        slot, rank = np.nonzero(np.arange(self.best.keep) < self.best.count[:, None])
        for a in range(0, len(slot), 50_000):
            s, r = slot[a:a + 50_000], rank[a:a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.names[s // self.wanted]), pa.array((s % self.wanted).astype(np.int32)),
                 pa.array(self.best.score[s, r]), pa.array(self.best.ids[s, r])], ["anchor", "slot", "score", "vec_id"])


def _floats(ints: np.ndarray):
    """Rows as each kind of ``_WHOLE``, with their largest norm; nothing for Python integers."""
    if ints.dtype == object:
        return None
    rows = ints.astype(float)
    most = float(np.sqrt((rows * rows).sum(1).max(initial=0.0)))
    return [(rows.astype(kind), most) for kind in _WHOLE]


def _met(keep: int, same: bool):
    """A task's rows, cell by cell, a cell's blocks before its chunks, to the best rows of each anchor and window."""
    def run(batches):
        cell, blocks, anchors = None, {}, {}

        def passed():
            for mine in anchors.values():
                for x in mine:
                    yield from x.found()

        for b in batches:
            for r in range(b.num_rows):
                row = {name: b.column(k)[r] for k, name in enumerate(b.schema.names)}
                row = {k: x.as_buffer() if isinstance(x, pa.BinaryScalar) and x.is_valid else x.as_py() for k, x in row.items()}
                if row["cell"] != cell:
                    yield from passed()
                    cell, blocks, anchors = row["cell"], {}, {}
                n, dim = row["rows"], row["dim"]
                if row["codes"] is None:
                    blocks.setdefault((dim, row["wanted"]), []).append(row)
                    continue
                for kind in [x for x in blocks if x[0] == dim]:
                    anchors.setdefault(dim, []).append(_Anchors(*kind, blocks.pop(kind), keep))
                if dim not in anchors:
                    continue
                ints = _ints(row["ints"], n, dim)
                chunk = {"ids": np.frombuffer(row["ids"], np.int64), "labels": np.frombuffer(row["labels"], np.int64),
                         "ints": ints, "floats": _floats(ints), "codes": np.frombuffer(row["codes"], np.uint64).reshape(n, -1),
                         "bounds": np.frombuffer(row["bounds"]).reshape(3, n).T}
                for x in anchors[dim]:
                    x.meet(chunk, same)
        yield from passed()
    return run


def _grid(chunks: int, rows: int, blocks: int, anchors: int, tasks: int) -> tuple[int, int]:
    """Into how many shares the chunks and the blocks are dealt: a cell for each task if there is enough, and
    little that travels.  A block is sent, and its anchors' best rows come back, once for each share of the
    chunks (about 4 rows' worth for an anchor); a chunk is sent once for each share of the blocks."""
    across = max(1, -(-anchors // _HELD), round((tasks * 4 * anchors / max(1, rows)) ** 0.5), -(-tasks // max(1, chunks)))
    across = min(max(1, blocks), across)
    return min(max(1, chunks), -(-tasks // across)), across


def _best_rows(chunks: DataFrame, anchors: DataFrame, keep: int, same: bool) -> DataFrame:
    """anchor, slot and its best rows (array of (lost, vec_id), best first; lost: minus the score).

    Chunks and blocks are numbered one after the other in each task that made them, and are
    dealt in turn; every chunk meets every block in one cell."""
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(anchors.select("anchor", "vec_id", "label", "v", "low", "high").repartition("anchor").mapInArrow(
        _blocks, _BLOCK_COLUMNS), "anchor-blocks")
    counted = [x for df in (chunks, blocks) for x in df.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()]
    down, across = _grid(*counted, tasks)

    def dealt(n):
        made, at = F.shiftright("number", 32), F.col("number").bitwiseAND(F.lit((1 << 32) - 1))
        return F.pmod(F.pmod(F.xxhash64(made), F.lit(n)) + at, F.lit(n))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    sent = (chunks.withColumn("share", dealt(down)).withColumn("column", every(across)).unionByName(
        blocks.withColumn("column", dealt(across)).withColumn("share", every(down)), allowMissingColumns=True)
        .withColumn("cell", (F.col("share") * across + F.col("column")).cast("int")).drop("share", "column"))
    met = sent.repartitionById(down * across, "cell").sortWithinPartitions("cell", F.col("codes").isNotNull())
    found = met.mapInArrow(_met(keep, same), "anchor long, slot int, score long, vec_id long")
    each = found.groupBy("anchor", "slot", "vec_id").agg(F.min(-F.col("score")).alias("lost"))
    return each.groupBy("anchor", "slot").agg(F.slice(F.sort_array(F.collect_list(F.struct("lost", "vec_id"))), 1, keep).alias("best"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """For each anchor and each of its ``positives`` nearest rows of the same label, the
    ``negatives`` best rows of other labels whose score is ``lowest`` to ``highest``
    percent of the positive's.  ``rows`` and ``anchors``: vec_id, label, v (``prepared``).

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    chunks = stored(chunks_of(rows), "vector-chunks")
    asked = stored(anchors.select("vec_id", "label", "v").distinct()
                   .withColumn("anchor", F.xxhash64("vec_id", "label", "v")), "anchors")
    whole = asked.select("anchor", "vec_id", "label", "v", F.array(F.lit(-_LONG)).alias("low"), F.array(F.lit(_LONG)).alias("high"))
    near = stored(_best_rows(chunks, whole, positives, True), "positives")
    score = lambda x: -x["lost"]
    # 100 * negative within [50, 95] * positive, in whole numbers; nothing fits below zero.
    windows = near.select("anchor", "best", F.transform("best", lambda x: F.ceil(score(x) * F.lit(lowest).cast("decimal(3,0)") / 100).cast("long")).alias("low"),
                          F.transform("best", lambda x: F.floor(score(x) * F.lit(highest).cast("decimal(3,0)") / 100).cast("long")).alias("high"))
    windowed = asked.join(windows, "anchor")
    far = _best_rows(chunks, windowed.select("anchor", "vec_id", "label", "v", "low", "high"), negatives, False)
    named = asked.select("anchor", F.col("vec_id").alias("anchor_id")).join(near.select("anchor", "best"), "anchor")
    found = far.select("anchor", "slot", F.posexplode("best").alias("at", "hit"))
    return (found.join(named, "anchor").withColumn("positive", F.element_at("best", F.col("slot") + 1))
            .select("anchor_id", F.col("positive.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
                    F.col("hit.vec_id").alias("negative_id"), (-F.col("positive.lost")).alias("positive_score"),
                    (-F.col("hit.lost")).alias("negative_score")))


def mine(vectors: DataFrame) -> DataFrame:
    """The registered query: every row whose vec_id is divisible by 50, against all rows."""
    rows = relabelled(prepared(vectors))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3
"""
