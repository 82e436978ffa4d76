"""Hidden Markov language model (operator 1).

Tokens are lower-cased words, each text closed by an end token.  Every word
belongs to one of ``CLASSES`` classes: the end token and the most common words
have their own, other words share one by their last bytes.  Given the hidden
state a class is emitted, given the class a word, so

    P(text) = P(classes | HMM) * product of P(word | class),

with P(word | class) = (c + 1) / (N_class + V_class + 1); the missing mass is the
class's unseen word.  The states are trained by Baum-Welch: every partition adds
up its expected counts, Spark adds up the partitions', and the next iteration
starts from them.  The scaled forward recursion gives the exact likelihood.

Counting and look-up: documents are cut into chunks, each with its own list of
distinct words.  Word counts are summed over all chunks' lists, joined back to
them, and each chunk then looks its tokens up in its own list; no vocabulary is
ever collected or broadcast.  Bounded by parameters alone: the most common words
(``OWN``), the class totals and the state tables.

Null and empty texts consist of the end token alone.  Repeated rows are scored and
learned from as often as they occur.  A row without doc_id counts as remainder 0.
Without training rows every word is unknown and the states keep their start values.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, crc_mod, record, stored, texts

STATES = 8
OWN = 2048        # words with a class of their own
SHARED = 2048     # classes of all other words
CLASSES = OWN + SHARED
ITERATIONS = 3
CHUNK = 12_000_000      # bytes of text in a chunk
END = b"\n"             # no word holds white space
_LOCKSTEP = 1_000_000   # tokens that move through the recursion together


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end token."""
    out = text.encode().lower().split()
    out.append(END)
    return out


def word_class(word: bytes, own: dict[bytes, int]) -> int:
    k = own.get(word)
    return OWN + zlib.crc32(word[-4:]) % SHARED if k is None else k


# -- chunks ----------------------------------------------------------------

_CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                           ("sizes", pa.list_(pa.int32())), ("at", pa.binary()), ("words", pa.list_(
                               pa.struct([("w", pa.binary()), ("n", pa.int64())])))])


class _Numbers(dict):
    def __missing__(self, w):
        k = self[w] = len(self)
        return k


def _squeezed(numbers: np.ndarray) -> bytes:
    """Four-byte numbers, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unsqueezed(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _chunk_rows(batches):
    numbers, ids, held, at, sizes, size = _Numbers(), [], [], [], [], 0

    def close():
        flat = np.concatenate(at)
        learned = np.repeat(~np.array(held, bool), sizes)
        n = np.bincount(flat[learned], minlength=len(numbers))
        words = pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), pa.StructArray.from_arrays(
            [pa.array(list(numbers), pa.binary()), pa.array(n, pa.int64())], fields=list(_CHUNK_SCHEMA.field("words").type.value_type)))
        return record(_CHUNK_SCHEMA, [[uuid.uuid4().int >> 65], [ids], [held], [sizes], [_squeezed(flat)], words])

    for docs, rows, out in batches_of(batches, "doc_id", "text", "held_out"):
        for doc, text, h in zip(docs, rows, out):
            ws = tokens(text)
            at.append(np.fromiter(map(numbers.__getitem__, ws), np.int32, len(ws)))
            ids.append(doc), held.append(h), sizes.append(len(ws))
            size += len(text)
            if size > CHUNK:
                yield close()
                numbers, ids, held, at, sizes, size = _Numbers(), [], [], [], [], 0
    if ids:
        yield close()


def chunked(docs: DataFrame, held_out) -> DataFrame:
    rows = texts(docs, held_out.alias("held_out"))
    return stored(rows.mapInArrow(_chunk_rows, "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, "
                                               "at binary, words array<struct<w:binary,n:long>>"), "hmm-chunks")


# -- the recursion ---------------------------------------------------------

def _lockstep(sizes: np.ndarray):
    """Documents by falling length, in groups of bounded token counts that step together."""
    order = np.argsort(-sizes, kind="stable")
    upto = np.cumsum(sizes[order])
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _LOCKSTEP, "right")))
        yield order[a:b]
        a = b


def _layout(flat, starts, sizes):
    """Tokens ordered by step, then document: (classes, first token of each step, of
    each token its document's rank)."""
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # documents longer than the step
    first = np.concatenate([[0], np.cumsum(active)])
    rank = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(rank)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = first[step] + rank
    cls = np.empty(len(rank), np.int64)
    cls[place] = flat[np.repeat(starts, sizes) + step]
    return cls, first


def forward(cls, first, model):
    """Scaled forward variables and the scale of every token."""
    start, move, emit = model
    e = emit[cls]
    alpha = np.empty_like(e)
    scale = np.empty(len(cls), np.float32)
    ones = np.ones(e.shape[1], np.float32)
    n = first[1]
    a = e[:n] * start
    for t in range(len(first) - 1):
        lo, hi = first[t], first[t + 1]
        if t:
            a = np.dot(alpha[before:before + hi - lo], move)
            a *= e[lo:hi]
        s = np.dot(a, ones)
        np.divide(a, s[:, None], out=alpha[lo:hi])
        scale[lo:hi] = s
        before = lo
    return alpha, scale, e


def log_likelihood(scale, first, n_docs):
    total, logs = np.zeros(n_docs), np.log(scale.astype(np.float64))
    rank = np.arange(len(scale)) - np.repeat(first[:-1], np.diff(first))
    np.add.at(total, rank, logs)
    return total


def expected_counts(cls, first, model):
    """Start, transition and emission counts that a group of documents adds."""
    start, move, emit = model
    alpha, scale, e = forward(cls, first, model)
    k = e.shape[1]
    weighted = e / scale[:, None]        # becomes emission * beta / scale
    beta = np.ones((len(cls), k), np.float32)
    back = np.ascontiguousarray(move.T)
    moves = np.zeros((k, k), np.float32)
    for t in range(len(first) - 2, 0, -1):
        lo, hi = first[t], first[t + 1]
        w = weighted[lo:hi]
        w *= beta[lo:hi]
        at = first[t - 1]
        np.dot(w, back, out=beta[at:at + hi - lo])
        moves += np.dot(alpha[at:at + hi - lo].T, w)
    gamma = np.multiply(alpha, beta, out=beta)  # scaled so that a token's states sum to 1
    moves *= move
    seen = np.stack([np.bincount(cls, gamma[:, j], minlength=len(emit)) for j in range(k)], 1)
    return gamma[:first[1]].sum(0, dtype=np.float64), moves.astype(np.float64), seen


def _start_model(class_share: np.ndarray, states: int):
    rng = np.random.default_rng(11)
    emit = class_share[:, None] * (rng.gamma(0.3, 1.0, (len(class_share), states)) + 1e-3)
    emit[0] = class_share[0]
    move = np.full((states, states), 0.01 / max(1, states - 1))  # states that last make long contexts show early
    np.fill_diagonal(move, 0.99 if states > 1 else 1.0)
    return _normal(np.ones(states), move, emit)


def _normal(start, move, emit):
    return ((start / start.sum()).astype(np.float32), (move / move.sum(1, keepdims=True)).astype(np.float32),
            (emit / emit.sum(0, keepdims=True)).astype(np.float32))


def _sequences(batch):
    """Per row of a batch of class sequences: concatenated classes, starts, sizes."""
    blobs = batch.column(batch.schema.get_field_index("cls")).to_pylist()
    sizes = np.array([len(x) // 2 for x in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), "<u2").astype(np.int64), np.cumsum(sizes) - sizes, sizes


def _gathered(batches, most=12_000_000):
    """Arrow batches put together up to a bounded number of bytes, so that documents of like length can step together."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def baum_welch(sequences: DataFrame, class_share: np.ndarray, states: int, iterations: int):
    """Train on the ``cls`` column (two-byte class numbers) of every row."""
    model = _start_model(class_share, states)
    names = [f"s{j}" for j in range(states)]
    for _ in range(iterations):
        def expect(batches, model=model):
            start, move, seen = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
            for b in _gathered(batches):
                flat, starts, sizes = _sequences(b)
                for docs in _lockstep(sizes):
                    s, m, c = expected_counts(*_layout(flat, starts[docs], sizes[docs]), model)
                    start += s
                    move += m
                    seen += c
            rows = np.concatenate([seen, move, start[None, :]])
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(rows[some, j]) for j in range(states))],
                                             names=["row", *names])

        added = (sequences.select("cls").mapInArrow(expect, "row int, " + ", ".join(f"{n} double" for n in names))
                 .groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).collect())  # CLASSES + STATES + 1 rows at most
        total = np.zeros((CLASSES + states + 1, states))
        for r in added:
            total[r["row"]] = r[1:]
        seen, move, start = total[:CLASSES], total[CLASSES:-1], total[-1]
        prior = class_share[:, None] * 10.0
        model = _normal(start + 1.0, move + 1.0, seen + prior)
    return model


# -- the operator ----------------------------------------------------------

def score_documents(docs: DataFrame, held_out, states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """Learn from the rows where ``held_out`` (a boolean column) is false, score all."""
    chunks = chunked(docs, held_out)
    pairs = chunks.select("chunk", F.posexplode("words").alias("pos", "x")).select("chunk", "pos", "x.w", "x.n")
    # one shuffle by word: each entry of a chunk's list gets the word's count over all chunks
    word = Window.partitionBy("w")
    counted = stored(pairs.select("w", "chunk", "pos", F.sum("n").over(word).alias("c"),
                                  F.row_number().over(word.orderBy("chunk")).alias("k")), "hmm-counts")
    counts = counted.where("k = 1").select("w", "c")
    learned = counts.where("c > 0")
    n_all, v_all = learned.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    top = learned.where(F.col("w") != F.lit(bytearray(END))).orderBy(F.desc("c"), "w").limit(OWN - 1).collect()
    own = {END: 0, **{bytes(r["w"]): k + 1 for k, r in enumerate(top)}}
    shared = F.lit(OWN) + F.crc32(F.expr("substring(w, -4, 4)")) % SHARED
    # classes of the words without their own: totals in SQL; the own words' counts are known
    rest = learned.join(F.broadcast(docs.sparkSession.createDataFrame([(bytearray(w),) for w in own], "w binary")),
                        "w", "left_anti")  # OWN rows
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest.groupBy(shared.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        class_n[r["k"]], class_v[r["k"]] = r["c"], r["v"]
    for r in top:
        class_n[own[bytes(r["w"])]], class_v[own[bytes(r["w"])]] = r["c"], 1
    class_n[0], class_v[0] = n_all - class_n[1:].sum(), float(n_all > 0)
    class_share = (class_n + 0.5) / (class_n.sum() + 0.5 * CLASSES)
    base_total = math.log10(n_all + v_all + 1)

    def look_up(left, right):
        """One chunk with the counts of its words: a row per document."""
        out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                         ("base_score", pa.float64()), ("word_score", pa.float64()), ("cls", pa.binary())])
        row = left.to_batches()[0] if left.num_rows else None
        if row is None:
            return pa.Table.from_batches([], out)
        get = lambda c: left.column(c)[0]
        held, sizes = np.array(get("held").as_py(), bool), np.array(get("sizes").as_py(), np.int64)
        at = _unsqueezed(get("at").as_py(), int(sizes.sum()))
        words = get("words").values.field("w").to_pylist()
        c = np.zeros(len(words), np.int64)
        c[right.column("pos").to_numpy()] = right.column("c").to_numpy()
        cls = np.fromiter((word_class(w, own) for w in words), np.int64, len(words))
        base = np.log10(c + 1.0) - base_total
        inner = np.log10(c + 1.0) - np.log10(class_n[cls] + class_v[cls] + 1.0)
        starts = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x[at], starts)
        seq = cls.astype("<u2")[at]
        return pa.Table.from_batches([record(out, [
            get("doc_ids").values, held, sizes, total((c > 0).astype(np.int64)), total(base), total(inner),
            [seq[s:s + n].tobytes() for s, n in zip(starts, sizes)]])])

    found = counted.select(F.col("chunk").alias("of_chunk"), "pos", "c")
    known = stored(chunks.groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(
        look_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, word_score double, cls binary"),
        "hmm-known")
    model = baum_welch(known.where("not held_out"), class_share, states, iterations)

    def score(batches):
        out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                         ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        for b in _gathered(batches):
            flat, starts, sizes = _sequences(b)
            logs = np.zeros(len(sizes))
            for docs_ in _lockstep(sizes):
                cls, first = _layout(flat, starts[docs_], sizes[docs_])
                logs[docs_] = log_likelihood(forward(cls, first, model)[1], first, len(docs_))
            col = lambda c: b.column(b.schema.get_field_index(c))
            yield record(out, [col("doc_id"), col("held_out"), col("n_tokens"), col("n_known"), np.full(b.num_rows, n_all),
                               col("base_score"), logs / math.log(10) + col("word_score").to_numpy()])

    return known.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                   "base_score double, score double")


def held_out_rows(modulus: int = 7, remainder: int = 2):
    return crc_mod("doc_id", modulus) == remainder
