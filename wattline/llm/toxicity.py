"""Toxicity by maximum-scoring segments (operator 9).

Token weights are log-odds of toxic against clean documents with a Dirichlet
prior that follows the whole training vocabulary; a word that is not itself
significant takes the weight of its prefix (its prior class).  All other tokens
share one small negative weight, the log-odds of "no significant token", so a
linear scan (every maximal-scoring segment of a sequence) yields the passages.
A segment's score S over n tokens has the extreme-value expectation
``E = K n exp(-lambda S)``; a document adds up ``-ln E`` over its significant
segments, and that sum is calibrated to a probability on the labelled rows.

Fit: labelled rows are bounded by ``max_labelled`` (a hash of doc_id chooses
them); a document with several labels counts as toxic if any says so.
Documents with null or empty text have no segments and get the score of such
documents.  Repeated rows give repeated rows.  Without any label every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, crc_mod, record, stored, texts

MAX_LABELLED = 200_000   # labelled rows used for the fit
MAX_FEATURES = 100_000   # significant features kept, by z
PREFIX = 4               # code points of a word's prefix class
PRIOR = 500.0            # mass of the Dirichlet prior
MIN_Z, MIN_WEIGHT = 3.0, 1.5
BINS = 48

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_TOKEN = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


class _Prefixes(dict):
    def __missing__(self, word):
        s = word.decode("utf-8", "ignore")
        p = self[word] = ("^" + s[:PREFIX]).encode() if len(s) > PREFIX else None
        return p


class _Weights(dict):
    """Weight of every word: its own, else its prefix's, else 0."""

    def __init__(self, features):
        super().__init__(features)
        self.features = features

    def __missing__(self, word):
        s = word.decode("utf-8", "ignore")
        w = self[word] = self.features.get(("^" + s[:PREFIX]).encode(), 0.0) if len(s) > PREFIX else 0.0
        return w

    def trim(self, most=1_000_000):
        if len(self) > most:
            self.clear()
            self.update(self.features)


def _count(batches):
    """Documents that hold each word or prefix, by label, summed per task."""
    toxic, clean, prefix = Counter(), Counter(), _Prefixes()
    n = [0, 0, 0, 0]
    schema = pa.schema([("feature", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def flush():
        keys = list(toxic.keys() | clean.keys())
        out = record(schema, [keys, [toxic[k] for k in keys], [clean[k] for k in keys]])
        toxic.clear(), clean.clear(), prefix.clear()
        return out

    for rows, labels in batches_of(batches, "text", "toxic"):
        for text, label in zip(rows, labels):
            words = tokens(text)
            seen = set(words)
            (toxic if label else clean).update(seen | (set(map(prefix.__getitem__, seen)) - {None}))
            n[0 if label else 1] += len(seen)
            n[2 if label else 3] += len(words)
        if len(toxic) + len(clean) > 400_000:
            yield flush()
    yield flush()
    yield record(schema, [[b"#types", b"#tokens"], [n[0], n[2]], [n[1], n[3]]])


def maximal_segments(hits, drift: float):
    """All maximal-scoring segments, in one pass.  ``hits``: (position, weight > 0)
    in order; every other token weighs ``drift`` < 0.  Yields (first, last, score)."""
    done = []  # [first, last, total before, total after]
    total, at = 0.0, -1
    for i, w in hits:
        total += drift * (i - at - 1)
        seg = [i, i, total, total + w]
        total += w
        at = i
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][2] >= seg[2]:
                j -= 1
            if j < 0 or done[j][3] >= seg[3]:
                break
            seg[0], seg[2] = done[j][0], done[j][2]
            del done[j:]
        done.append(seg)
    return [(a, b, after - before) for a, b, before, after in done]


def segments_of(text: str, weights: _Weights, model: dict):
    """(token count, significant segments as (first, last token, -ln E))."""
    words = tokens(text)
    hits = [(i, w) for i, w in enumerate(map(weights.__getitem__, words)) if w]
    if not hits:
        return len(words), []
    floor = math.log(model["k"] * len(words))
    found = [(a, b, model["lambda"] * s - floor) for a, b, s in maximal_segments(hits, model["drift"])]
    return len(words), [x for x in found if x[2] > 0]


def _evidence(text, weights, model):
    return sum(x[2] for x in segments_of(text, weights, model)[1])


def _bin(x: float) -> int:
    return 0 if x <= 0 else min(BINS - 1, 1 + int(4 * math.log1p(x)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """Learn from the labelled rows (``labels``: doc_id, toxic) that the caller allows."""
    lab = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    n = lab.count()
    if n > max_labelled:
        lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    train = texts(docs).join(F.broadcast(lab), "doc_id").select("text", "toxic")  # at most max_labelled pairs of numbers

    counts = stored(train.mapInArrow(_count, "feature binary, toxic long, clean long")
                    .groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")), "toxic-counts")
    total = {bytes(r["feature"]): (r["t"], r["c"]) for r in counts.where(
        F.col("feature").isin(bytearray(b"#types"), bytearray(b"#tokens"))).collect()}
    model = {"features": {}, "drift": -0.01, "lambda": 1.0, "k": 1e-3, "curve": ([0.0, 1.0], [0.0, 0.0])}
    nt, nc = total.get(b"#types", (0, 0))
    if not nt or not nc:
        return model

    prior = F.greatest(F.lit(0.5), (F.col("t") + F.col("c")) * F.lit(PRIOR / (nt + nc)))  # half a document at least
    t, c = F.col("t") + prior, F.col("c") + prior
    odds = F.log(t / (nt + PRIOR - t)) - F.log(c / (nc + PRIOR - c))
    sig = (counts.where(~F.col("feature").isin(bytearray(b"#types"), bytearray(b"#tokens")))
           .select("feature", "t", "c", odds.alias("w"), (odds / F.sqrt(1 / t + 1 / c)).alias("z"))
           .where((F.col("z") >= MIN_Z) & (F.col("w") >= MIN_WEIGHT) & (F.col("t") >= 3))
           .orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect())
    if not sig:
        return model
    model["features"] = {bytes(r["feature"]): float(r["w"]) for r in sig}
    words = [r for r in sig if not bytes(r["feature"]).startswith(b"^")] or sig
    tt, tc = total[b"#tokens"]
    hit_t = min(0.5, sum(r["t"] for r in words) / tt)
    rate = [(max(r["c"], 0.5) / tc, float(r["w"])) for r in words]
    hit_c = min(0.4, sum(p for p, _ in rate))
    model["drift"] = min(-0.002, max(-0.2, math.log((1 - hit_t) / (1 - hit_c))))
    lo, hi = 1e-6, 4.0  # the positive root of E[exp(lambda s)] = 1 over clean text
    for _ in range(60):
        mid = (lo + hi) / 2
        value = sum(p * math.exp(min(50.0, mid * w)) for p, w in rate) + (1 - hit_c) * math.exp(mid * model["drift"])
        lo, hi = (mid, hi) if value < 1 else (lo, mid)
    model["lambda"], model["k"] = max(lo, 0.05), max(hit_c, 1e-9)

    def tally(batches):
        weights, n = _Weights(model["features"]), np.zeros((BINS, 3))
        for rows, labels_ in batches_of(batches, "text", "toxic"):
            for text, label in zip(rows, labels_):
                x = _evidence(text, weights, model)
                n[_bin(x)] += (bool(label), not label, x)
            weights.trim()
        yield pa.RecordBatch.from_pydict({"bin": list(range(BINS)), "t": n[:, 0], "c": n[:, 1], "x": n[:, 2]})

    rows = sorted(train.mapInArrow(tally, "bin long, t double, c double, x double").groupBy("bin")
                  .agg(F.sum("t"), F.sum("c"), F.sum("x")).collect())
    model["curve"] = _monotone([tuple(r)[1:] for r in rows if r[1] + r[2]])
    return model


def _monotone(bins):
    """Pool adjacent bins until the rates rise; points (evidence, rate), smoothed."""
    pools = []
    for t, c, x in bins:
        pools.append([t, c, x])
        while len(pools) > 1 and _rate(pools[-2]) >= _rate(pools[-1]):
            b = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], b)]
    xs, ys = [p[2] / (p[0] + p[1]) for p in pools], [_rate(p) for p in pools]
    return xs + [xs[-1] + 50.0], ys + [1 - (1 - ys[-1]) / 2]


def _rate(p):
    return (p[0] + 0.02) / (p[0] + p[1] + 0.2)


def score_documents(docs: DataFrame, model: dict, passages: bool = True) -> DataFrame:
    """doc_id, score and the significant passages (code-point offsets, -ln E)."""
    def run(batches):
        weights, (xs, ys) = _Weights(model["features"]), model["curve"]
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("passages", pa.string())])
        for ids, rows in batches_of(batches, "doc_id", "text"):
            evidence, spans = [], []
            for text in rows:
                found = segments_of(text, weights, model)[1] if text else []
                evidence.append(sum(x[2] for x in found))
                if found and passages:
                    at = [m.span() for m in _TOKEN.finditer(text)]
                    spans.append(",".join(f"{at[a][0]}:{at[b][1]}:{s:.2f}" for a, b, s in found))
                else:
                    spans.append("")
            weights.trim()
            yield record(schema, [ids, np.interp(evidence, xs, ys), spans])
    return texts(docs).mapInArrow(run, "doc_id long, score double, passages string")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of the rows that may be learned from (crc32 of doc_id mod 4 is not 2)."""
    return labels.where(crc_mod("doc_id", 4) != 2)


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    def run(batches):
        weights, (xs, ys) = _Weights(model["features"]), model["curve"]
        for b in batches:
            rows = b.column(b.schema.get_field_index("text")).to_pylist()
            scores = np.interp([_evidence(t, weights, model) if t else 0.0 for t in rows], xs, ys)
            weights.trim()
            yield b.filter(pa.array(scores < threshold))
    return docs.mapInArrow(run, docs.schema)
