"""Variable-capacity best-fit packing (operator 6).

Documents become pieces of at most the largest permitted length (a longer one is
cut, nothing is dropped).  Pieces are dealt by hash into shards of bounded size,
and each shard is packed by best fit, longest first, over several permitted bin
lengths at once: a piece goes to the open bin it fills most tightly; without one
a bin is opened, of the length whose cost per token it can hold is least under the
shard's opening rule.  Every opening rule (a smallest length that may be opened) is
tried, and the cheapest result after downsizing counts.  At last every bin shrinks
to the least costly permitted length that holds its contents.

Lengths are token ids of the tokenizer that ``token_files`` writes with.  Null and empty texts take one place (their end token).  Repeated rows are packed as
often as they occur, told apart by their position among rows equal in id and text.
Rows without doc_id are packed too.  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, record, slices, stored, texts
from .token_files import encoder

LENGTHS = (512, 1024, 2048, 4096, 8192)
SHARD = 20_000           # pieces in a shard, about
REMEMBERED = 300_000     # pieces a worker remembers beside what other stages hold
BLOCK = 100_000          # copies of one row that are numbered together
OVERHEAD = 16            # cost of a bin beside its length


def costs(lengths=LENGTHS, overhead=OVERHEAD) -> list[int]:
    return [n + overhead for n in lengths]


def downsize(used: int, lengths, cost) -> int:
    """Number of the least costly permitted length that holds ``used``."""
    return min((k for k, n in enumerate(lengths) if n >= used), key=lambda k: (cost[k], lengths[k]))


def _pack_once(sizes, lengths, cost, least: int):
    """Bins (lists of positions) by best fit with bins of at least lengths[least]."""
    order = np.argsort(-sizes, kind="stable")
    room: dict[int, list[int]] = {}
    rooms: list[int] = []          # distinct free sizes, ascending
    bins: list[list[int]] = []
    left = int(sizes.sum())
    for i in order.tolist():
        n = int(sizes[i])
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            free = rooms[k]
            b = room[free].pop()
            if not room[free]:
                del room[free], rooms[k]
        else:
            able = [j for j, c in enumerate(lengths) if c >= n and j >= least] or [len(lengths) - 1]
            j = min(able, key=lambda j: (cost[j] / min(lengths[j], max(left, n)), lengths[j]))
            b, free = len(bins), lengths[j]
            bins.append([])
        bins[b].append(i)
        left -= n
        free -= n
        if free:
            if free not in room:
                bisect.insort(rooms, free)
                room[free] = []
            room[free].append(b)
    return bins


def pack(sizes: np.ndarray, lengths=LENGTHS, cost=None):
    """(bins, their length numbers) of the cheapest opening rule."""
    cost = cost or costs(lengths)
    best = None
    for only in [None, *range(len(lengths))]:
        allowed = lengths if only is None else lengths[:only + 1]
        if len(sizes) and allowed[-1] < sizes.max():
            continue
        bins = _pack_once(sizes, allowed, cost[:len(allowed)], 0 if only is None else only)
        ends = [downsize(int(sizes[b].sum()), lengths, cost) for b in bins]
        total = sum(cost[k] for k in ends)
        if best is None or total < best[0]:
            best = total, bins, ends
    return best[1], best[2]


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text_hash, row (number of an equal row) and n_tokens: the text's ids by the tokenizer file
    and an end id, as ``token_files`` writes them.  Equal rows travel as one row with their count; they are
    numbered in blocks that go to tasks of their own, so one row's copies never unroll in one task."""
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64())])
        from xxhash import xxh3_64_intdigest
        enc = encoder(tokenizer, REMEMBERED)
        for ids, rows in batches_of(slices(batches, "text", 4_000_000), "doc_id", "text"):
            yield record(schema, [ids, [xxh3_64_intdigest(t.encode()) - (1 << 63) for t in rows], enc.lengths(rows)])

    same = texts(docs).mapInArrow(run, "doc_id long, text_hash long, n_tokens long").groupBy("doc_id", "text_hash", "n_tokens").count()
    blocks = (same.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"(count - 1) div {BLOCK}"))))
              .repartition("doc_id", "text_hash", "block"))
    last = F.least(F.lit(BLOCK), F.col("count") - F.col("block") * BLOCK) - 1
    return (blocks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .select("doc_id", "text_hash", "n_tokens", (F.col("block") * BLOCK + F.col("i")).alias("row")))


def best_fit(lengths_of: DataFrame, lengths=LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """Pack rows (doc_id, text_hash, row, n_tokens); one result row for each piece:
    doc_id, text_hash, row, piece, first_token, n_tokens, bin_id, bin_offset, bin_capacity, bin_used."""
    if list(lengths) != sorted(set(lengths)) or lengths[0] < 1:
        raise ValueError("lengths must rise")
    longest = lengths[-1]
    pieces = stored(lengths_of.select("doc_id", "text_hash", "row", "n_tokens", F.explode(
        F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / longest))).alias("piece"))
        .select("doc_id", "row", "piece", "text_hash", (F.col("piece") * longest).alias("first_token"),
                F.least(F.lit(longest), F.col("n_tokens") - F.col("piece") * longest).alias("n_tokens")), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", "row", "piece"), F.lit(shards)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "text_hash", "row", "piece")])
        sizes = t.column("n_tokens").to_numpy()
        bins, ends = pack(sizes, lengths, costs(lengths, overhead))
        number, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                number[i], offset[i] = b, at
                at += sizes[i]
        used = np.array([sizes[b].sum() for b in bins], np.int64)
        name = t.column("shard")[0].as_py() if len(sizes) else 0
        return pa.table({"doc_id": t.column("doc_id"), "text_hash": t.column("text_hash"), "row": t.column("row"), "piece": t.column("piece"),
                         "first_token": t.column("first_token"), "n_tokens": t.column("n_tokens"),
                         "bin_id": pa.array([f"{name}-{b}" for b in number]), "bin_offset": offset,
                         "bin_capacity": np.array([lengths[k] for k in ends], np.int64)[number], "bin_used": used[number]})

    return dealt.groupBy("shard").applyInArrow(
        run, "doc_id long, text_hash long, row long, piece long, first_token long, n_tokens long, bin_id string, bin_offset long, "
             "bin_capacity long, bin_used long")
