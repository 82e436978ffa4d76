"""Secret scan with a linear-chain conditional random field (operator 7).

Three fixed patterns give the base spans.  A CRF over token sequences (tags
outside, begin, inside) adds spans: its features are the token's shape, the
neighbouring words and features of the file, and Viterbi decodes it.  The CRF
is trained by gradient ascent on its exact likelihood, on windows of a bounded
hash sample of documents (``max_train_docs``) labelled by the base patterns,
with the pattern's cue words sometimes hidden so that shape alone must do.

What reaches the driver is bounded: at most ``max_windows`` windows of at most
``WINDOW_TOKENS`` tokens, each as four hashes a token.

Every token of every text is decoded, and any token may begin a secret: length,
character classes and the mix of digits and letters are features, not conditions.
Texts are decoded many at a time, one after another with outside tokens between.

Null and empty texts have no spans; repeated rows give repeated rows; an empty
table gives an empty result.  Offsets are code points, ends exclusive; spans
are ordered by start, then kind as listed in ``KINDS``.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, forget, record, slices, stored, texts, worker_state

KINDS = ("assign", "access", "hex", "crf")
MAX_TRAIN_DOCS = 20_000
MAX_TRAIN_WINDOWS = 4_000
CONTEXT = 6               # tokens on each side of a training window's middle
WEIGHTS = 1 << 14         # hashed feature space
WINDOW_TOKENS = 128       # tokens of a training window at most; a longer one is cut into several
_REMEMBERED = 300_000     # distinct tokens a task remembers
_AT_ONCE = 800_000        # characters decoded together (a longer text goes alone)

_CUE = re.compile("password|passwd|secret|token|api_?key", re.I | re.A)
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9_+/-]+|[^\sA-Za-z0-9_+/-]")


_VALUES = (string.ascii_letters, string.digits + string.ascii_letters, string.digits + string.ascii_lowercase,
           string.digits + string.ascii_uppercase, string.digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    out = []
    if _CUE.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _kind(token: str) -> int:
    """0 a mark or a letter beyond ASCII, 1 a word, 2 letters of mixed case, 3 a long word, 4 digits,
    5 digits and letters, 6 many digits and letters."""
    if not token.isascii() or not any(map(str.isalnum, token)):
        return 0
    if any(map(str.isdigit, token)):
        return 4 if not any(map(str.isalpha, token)) else 6 if len(token) >= 12 else 5
    return 2 if token[1:] not in (token[1:].lower(), token[1:].upper()) else 3 if len(token) >= 16 else 1


def _shape(token: str) -> str:
    if len(token) == 1 and not token.isalnum():
        return token
    kinds = (("h" if re.fullmatch("[0-9a-f]+", token) else "") + ("u" if any("A" <= c <= "Z" for c in token) else "")
             + ("l" if any("a" <= c <= "z" for c in token) else "") + ("d" if any(c.isdigit() for c in token) else "")
             + ("s" if any(c in "_+/-" for c in token) else ""))
    return f"{kinds}{min(8, len(token) // 5)}"


def _variety(token: str) -> int:
    n = len(token)
    return int(-2 * sum(k / n * math.log2(k / n) for k in map(token.count, set(token))))


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace"))


_OFFSETS = (-4, -3, -2, -1, 1, 2)
_ANY = 7                                                  # beside the seven kinds
_SALT = np.random.default_rng(11).integers(0, 1 << 32, (9 + 2 * len(_OFFSETS), _ANY + 1))
_GAP = "\n"               # the number of this token (0) stands between texts


class Tokens(dict):
    """Numbers of distinct tokens, with the hashes of what the features look at."""

    def __init__(self):
        super().__init__()
        self.new, self.columns, self[_GAP] = [(_hash("^"), _hash("^"), 0, 0)], np.zeros((4, 0), np.int64), 0

    def __missing__(self, t: str) -> int:
        k = self[t] = len(self)
        digits = sum(map(str.isdigit, t))
        mix = f"{_variety(t)}|{4 * digits // len(t)}|{min(24, len(t)) // 3}"
        self.new.append((_hash("s" + _shape(t)), _hash("w" + (t.lower() if len(t) < 16 and t.isalpha() else "*")), _hash(mix), _kind(t)))
        return k

    def of(self, numbers: np.ndarray) -> np.ndarray:
        if self.new:
            self.columns = np.concatenate([self.columns, np.array(self.new, np.int64).T], 1)
            self.new = []
        return self.columns[:, numbers]


def _own(shape, word, mix, kind):
    """Numbers of the features that look at the token alone."""
    yield _SALT[0][kind] & (WEIGHTS - 1)
    for x, salt in zip((shape, mix, shape * 31 + mix, word), _SALT[1:5, _ANY]):
        yield (x ^ salt) & (WEIGHTS - 1)


def _of_file(files, kind):
    for x, salt in zip(files, _SALT[5:8]):
        yield (x ^ salt[kind]) & (WEIGHTS - 1)


def features(columns: np.ndarray, files: np.ndarray):
    """Hashed feature numbers of every token, one array for each feature; ``files`` are the hashes of its
    text's features.  Rows begin and end with gaps, so neighbours do not reach into another text."""
    shape, word, _, kind = columns
    yield from _own(*columns)
    yield from _of_file(files, kind)
    salts = iter(_SALT[9:])
    for d in _OFFSETS:
        for x, salt in ((shape, next(salts)), (word, next(salts) if d > 0 else _SALT[8])):
            beside = np.roll(x, -d)
            yield (beside ^ salt[kind]) & (WEIGHTS - 1)
            yield (beside ^ salt[_ANY]) & (WEIGHTS - 1)


class _Notable(dict):
    """Whether a token is a cue word, an assignment mark or other than a word."""

    def __missing__(self, t: str) -> bool:
        if len(self) > _REMEMBERED:
            self.clear()
        k = self[t] = t in ":=" or _kind(t) > 1 or _CUE.fullmatch(t) is not None
        return k


def windows_of(text: str, base):
    """Windows (lists of (start, end)) around the base spans, cue words, assignment marks and tokens other
    than words, and around one token by hash."""
    toks = [m.span() for m in _TOKEN.finditer(text)]
    if not toks:
        return
    spots = {zlib.crc32(text.encode("utf-8", "replace")) % len(toks)}
    notable = worker_state().setdefault("secrets-notable", _Notable())
    spots.update(i for i, t in enumerate(_TOKEN.findall(text)) if notable[t])
    if base:
        spots.update(np.flatnonzero(_tags(toks, base)).tolist())
    begin = end = None
    for i in sorted(spots):
        if end is not None and i - CONTEXT > end:
            yield from _cut(toks[begin:end])
            begin = None
        begin = max(0, i - CONTEXT) if begin is None else begin
        end = i + CONTEXT + 1
    yield from _cut(toks[begin:end])


def _cut(window):
    return (window[i:i + WINDOW_TOKENS] for i in range(0, len(window), WINDOW_TOKENS))


def file_features(text: str) -> tuple[str, ...]:
    return (f"len{min(6, int(math.log10(len(text) + 1)))}",
            f"eq{min(3, text.count('='))}", f"br{min(3, text.count('{') + text.count(';'))}")


# -- the model -------------------------------------------------------------

_ALLOWED = np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool)  # from tag, to tag: inside never follows outside
_BAD = -1e9


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _expected(e, t, sizes):
    """Tag and transition probabilities of rows of ``sizes`` tokens (e: row, token, tag) by the
    forward-backward recursion; a row begins as after an outside token."""
    k, n = e.shape[:2]
    a, b = np.empty((n, k, 3)), np.zeros((n, k, 3))
    a[0] = e[:, 0] + t[0]
    for i in range(1, n):
        a[i] = e[:, i] + _lse(a[i - 1][:, :, None] + t, 1)
    for i in range(n - 2, -1, -1):
        b[i] = np.where((i + 1 < sizes)[:, None], _lse(t + (e[:, i + 1] + b[i + 1])[:, None, :], 2), 0)
    z = _lse(a[sizes - 1, np.arange(k)], 1)
    real = np.arange(n)[:, None] < sizes
    pairs = np.exp(a[:-1, :, :, None] + t + (e.transpose(1, 0, 2)[1:] + b[1:])[:, :, None, :] - z[:, None, None])
    return (np.exp(a + b - z[:, None]) * real[:, :, None]).transpose(1, 0, 2), pairs[real[1:]].sum(0)


def viterbi(e, t) -> list[int]:
    return best_tags(e, t).tolist()


def best_tags(e, t, block: int = 128) -> np.ndarray:
    """The best tags.  Long rows are cut into blocks that advance together, for each
    tag before the block; then the blocks are put one after another."""
    n = len(e)
    nb = (n - 1) // block if n > 16 * block else 0
    v, enter, tags = e[0] + (0, 0, _BAD), [], np.zeros(n, np.int8)
    if nb:
        x = np.ascontiguousarray(np.asarray(e[1:1 + nb * block], float).reshape(nb, block, 3).transpose(1, 2, 0))
        m = np.full((3, 3, nb), float(_BAD))  # tag now, tag before the block
        m[range(3), range(3)] = 0
        back = np.empty((block, 3, 3, nb), np.int8)
        for k in range(block):
            new = np.empty_like(m)
            for s in range(3):
                zero, one, two = m[0] + t[0, s], m[1] + t[1, s], m[2] + t[2, s]
                best = np.maximum(zero, one)
                back[k, s] = np.where(two > best, 2, one > zero)
                new[s] = np.maximum(best, two) + x[k, s]
            m = new
        for step in np.ascontiguousarray(m.transpose(2, 1, 0)):
            s = v[:, None] + step
            enter.append(s.argmax(0))
            v = s.max(0)
    rest = []
    for i in range(1 + nb * block, n):
        s = v[:, None] + t
        rest.append(s.argmax(0))
        v = s.max(0) + e[i]
    now = int(v.argmax())
    for i in range(n - 1, nb * block, -1):
        tags[i] = now
        now = int(rest[i - 1 - nb * block][now])
    if not nb:
        tags[0] = now
        return tags
    last, before = np.empty(nb, int), np.empty(nb, int)
    for j in range(nb - 1, -1, -1):
        last[j] = now
        now = before[j] = int(enter[j][now])
    tags[0] = now
    inner, at = tags[1:1 + nb * block].reshape(nb, block), np.arange(nb)
    for k in range(block - 1, -1, -1):
        inner[:, k] = last
        last = back[k, last, before, at]
    return tags


def train(windows, epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, batch: int = 16) -> dict | None:
    """``windows``: (feature numbers by token, tags).  AdaGrad on the exact likelihood."""
    if not any(1 in tags for _, tags in windows):
        return None
    w, t = np.zeros((WEIGHTS, 3)), np.zeros((3, 3))
    gw, gt = np.full((WEIGHTS, 3), 1e-6), np.full((3, 3), 1e-6)
    rng = np.random.default_rng(7)
    order = sorted(range(len(windows)), key=lambda k: len(windows[k][1]))
    groups = []
    for at in range(0, len(order), batch):
        part = [windows[k] for k in order[at:at + batch]]
        names, index = np.unique(np.concatenate([f for f, _ in part]), return_inverse=True)
        groups.append((part, np.array([len(tags) for _, tags in part]), names, index.reshape(-1, part[0][0].shape[1])))
    for _ in range(epochs):
        for k in rng.permutation(len(groups)):
            part, sizes, names, index = groups[k]
            real = np.arange(sizes.max()) < sizes[:, None]
            e = np.zeros((*real.shape, 3))
            e[real] = w[names][index].sum(1)
            p, pairs = _expected(e, np.where(_ALLOWED, t, _BAD), sizes)
            flow, miss = -pairs, -p[real]
            tags = np.concatenate([x for _, x in part])
            miss[np.arange(len(tags)), tags] += 1
            for _, x in part:
                np.add.at(flow, (x[:-1], x[1:]), 1)
            gt += flow ** 2
            t += rate * flow / np.sqrt(gt)
            flat = index.ravel()
            g = np.stack([np.bincount(flat, np.repeat(miss[:, c], index.shape[1]), len(names)) for c in range(3)], 1)
            g -= decay * w[names]
            gw[names] += g ** 2
            w[names] += rate * g / np.sqrt(gw[names])
    return {"w": w.astype(np.float32), "t": t, "name": uuid.uuid4().hex}


def _tags(spans, base):
    """Tags by the base patterns: the value of an assignment, or the whole match."""
    tags, inside, base, k = [], None, sorted(base), 0
    for s, e in spans:
        while k < len(base) and base[k][1] < e:
            k += 1
        hit = next((x for x in base[k:k + 3] if x[0] <= s and e <= x[1]), None)
        tags.append(0 if hit is None else 2 if hit == inside else 1)
        inside = hit
    return tags


def fit(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_windows: int = MAX_TRAIN_WINDOWS) -> dict | None:
    """Train on windows of at most about ``max_docs`` documents, at most four windows
    of each and ``max_windows`` in all, up to half of them with secrets (chosen by
    hash); None without any positive one."""
    n = docs.count()
    sample = texts(docs)
    if n > max_docs:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * max_docs / n))

    def cut(batches):
        for rows in (r for b in slices(batches, "text") for (r,) in batches_of([b], "text")):
            out = []
            for text in rows:
                base = [(m.start(1), m.end(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] \
                    if _CUE.search(text) else []
                base += [(s, e) for s, k, e in base_spans(text) if k]
                for _, spans in zip(range(4), windows_of(text, base)):
                    out.append(_example([text[a:b] for a, b in spans], _tags(spans, base), file_features(text)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.list_(t)) for k, t in
                                              enumerate((pa.int64(), pa.int32(), pa.int64()))], ["hashes", "tags", "file"])
        forget("secrets-notable")

    cuts = stored(sample.select("text").mapInArrow(cut, "hashes array<long>, tags array<int>, file array<long>"), "secret-windows")
    some = F.exists("tags", lambda x: x > 0)
    rows = [r for side in (some, ~some)
            for r in cuts.where(side).orderBy(F.xxhash64("hashes"), "tags", "file").limit(max_windows // 2).collect()]
    data = []
    for r in rows:
        n, gap = len(r["tags"]), max(map(abs, _OFFSETS))
        at = np.append(np.zeros(gap, np.int64), np.append(np.arange(1, n + 1), np.zeros(gap, np.int64)))
        columns = np.insert(np.array(r["hashes"], np.int64).reshape(n, 4).T, 0, Tokens().new[0], 1)[:, at]
        files = np.repeat(np.array([r["file"]], np.int64).T, len(at), 1)
        data.append((np.stack(list(features(columns, files)), 1)[at > 0], list(r["tags"])))
    return train(data)


def _example(toks: list[str], tags: list[int], file) -> tuple[list[int], list[int], list[int]]:
    """A training window as the hashes its features are made of, so that what the driver gathers does not
    depend on how long the tokens are.  In a third of the windows (by hash) the cue is hidden, so that shape
    and place must carry; in a quarter another value takes the secret's place, so that secrets of any
    length and class are learned."""
    k = _hash("\n".join(toks))
    if k % 3 == 0:
        toks = ["*" if _CUE.fullmatch(x) else x for x in toks]
    if k % 4 == 1:
        rng = np.random.default_rng(k)
        letters = list(_VALUES[k // 4 % len(_VALUES)])
        toks = ["".join(rng.choice(letters, rng.integers(7, 41))) if y and len(x) > 5 else x for x, y in zip(toks, tags)]
    known = Tokens()
    columns = known.of(np.array([known[x] for x in toks], np.int64))
    return columns.T.ravel().tolist(), tags, [_hash(f"f{x}") for x in file]


def _laid_out(known: Tokens, rows, files):
    """Token columns and file hashes of the token lists, with gaps around each, and the tokens' numbers."""
    gap = [0] * max(map(abs, _OFFSETS))
    at, sizes = list(gap), []
    for toks in rows:
        at += map(known.__getitem__, toks)
        at += gap
        sizes.append(len(toks) + len(gap))
    numbers = np.array(at, np.int64)
    hashes = np.array([[_hash(f"f{x}") for x in f] for f in files], np.int64).reshape(len(rows), -1)
    of_file = np.append(np.zeros(len(gap), np.int64), np.repeat(np.arange(len(rows)), sizes))
    return known.of(numbers), hashes[of_file].T, numbers


class _Scorer:
    """A model's weights (begin and inside against outside) as one table for each place, so that a token's
    scores are one look-up for each neighbour and one for itself."""

    def __init__(self, model):
        w, at = model["w"] - model["w"][:, :1], np.arange(WEIGHTS)
        self.w, self.known, self.own = w[:, 1:], Tokens(), np.zeros((0, 2), np.float32)
        kinds = np.arange(_ANY)

        def by_kind(salt):
            both = np.zeros((WEIGHTS, _ANY + 1, 2), np.float32)
            both[:, :_ANY] = (self.w[at[:, None] ^ (salt[kinds] & (WEIGHTS - 1))] + self.w[at ^ (salt[_ANY] & (WEIGHTS - 1))][:, None])
            return both.reshape(-1, 2).view(np.float64).ravel()
        before, salts = by_kind(_SALT[8]), iter(_SALT[9:])
        self.near = [(d, by_kind(next(salts)), by_kind(next(salts)) if d > 0 else before) for d in _OFFSETS]

    def scores(self, columns, numbers, files) -> np.ndarray:
        shape, word, mix, kind = columns
        fresh = self.known.columns[:, len(self.own):]
        own = np.zeros((fresh.shape[1], 2), np.float32)
        for f in _own(*fresh):
            own += self.w[f]
        self.own = np.concatenate([self.own, own])
        e = self.own[numbers]
        e += sum(self.w[f] for f in _of_file(files, kind))
        flat = e.reshape(-1)
        shape, word = ((x & (WEIGHTS - 1)) * (_ANY + 1) for x in (shape, word))
        for d, of_shape, of_word in self.near:
            flat += of_shape.take(np.roll(shape, -d) + kind).view(np.float32)
            flat += of_word.take(np.roll(word, -d) + kind).view(np.float32)
        return np.concatenate([np.zeros((len(e), 1), np.float32), e], 1)


def _scorer(model) -> _Scorer:
    kept = worker_state()
    if kept.get("secrets", ("",))[0] != model["name"] or len(kept["secrets"][1].known) > _REMEMBERED:
        kept["secrets"] = model["name"], _Scorer(model)
    return kept["secrets"][1]


def _runs(tags) -> list[list[int]]:
    """[first token, last token] of every decoded secret."""
    out = []
    for i in np.flatnonzero(tags):
        if tags[i] == 1:
            out.append([i, i])
        else:
            out[-1][1] = i
    return out


def crf_spans_of(rows: list[str], model) -> list[list[tuple[int, int]]]:
    """The secrets that the CRF decodes in each text."""
    out, part, size = [], [], 0
    for i, text in enumerate(rows):
        part.append(text)
        size += len(text)
        if i + 1 == len(rows) or size + len(rows[i + 1]) > _AT_ONCE:
            out += _decode(part, model)
            part, size = [], 0
    return out


def _decode(rows: list[str], model) -> list[list[tuple[int, int]]]:
    toks = [_TOKEN.findall(t) for t in rows]
    scorer = _scorer(model)
    columns, files, numbers = _laid_out(scorer.known, toks, [file_features(t) for t in rows])
    e = scorer.scores(columns, numbers, files)
    e[numbers == 0] = 0, _BAD, _BAD
    tags = best_tags(e, np.where(_ALLOWED, model["t"], _BAD))
    out, at = [], max(map(abs, _OFFSETS))
    for text, x in zip(rows, toks):
        found = _runs(tags[at:at + len(x)])
        spans = [m.span() for m in _TOKEN.finditer(text)] if found else []
        out.append([(spans[a][0], spans[b][1]) for a, b in found])
        at += len(x) + max(map(abs, _OFFSETS))
    return out


def crf_spans(text: str, model) -> list[tuple[int, int]]:
    return crf_spans_of([text], model)[0]


def find_spans_of(rows: list[str], model) -> list[list[tuple[int, int, int]]]:
    """(start, kind number, end): the base spans of each text and those the CRF decodes."""
    out = [base_spans(t) if t else [] for t in rows]
    if model is not None:
        for x, more in zip(out, crf_spans_of([t or "" for t in rows], model)):
            x += [(s, 3, e) for s, e in more]
    return [sorted(set(x)) for x in out]


def find_spans(text: str, model) -> list[tuple[int, int, int]]:
    return find_spans_of([text], model)[0]


def scan_secrets(docs: DataFrame, model) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans."""
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]),
                            ("base_sha256", pa.string()), ("spans", pa.string()), ("n_crf", pa.int64())])
        for ids, rows in batches_of(slices(batches, "text", 2_000_000), "doc_id", "text"):
            found = find_spans_of(rows, model)
            name = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in x] for x in found]
            base = [[y for y in x if not y.startswith("crf:")] for x in name]
            yield record(schema, [ids, *([sum(y[1] == k for y in x) for x in found] for k in range(3)),
                                  [hashlib.sha256(",".join(x).encode()).hexdigest() for x in base],
                                  [",".join(x) for x in name], [sum(y[1] == 3 for y in x) for x in found]])
        forget("secrets")
    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                       "spans string, n_crf long")


def redact(text: str, spans, mark: str) -> str:
    """The text with every span replaced; overlapping spans become one mark."""
    parts, at, last = [], 0, -1
    for s, _, e in spans:
        if s >= last:
            parts += [text[at:s], mark]
        at = last = max(last, e)
    return "".join(parts) + text[at:]


def redact_documents(docs: DataFrame, model, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets masked in ``text`` (and ``n_chars``, if present, counted anew)."""
    def run(batches):
        for b in slices(batches, "text", 2_000_000):
            k = b.schema.get_field_index("text")
            old = b.column(k).to_pylist()
            new = [t if not t else redact(t, x, mark) for t, x in zip(old, find_spans_of(old, model))]
            b = b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type))
            n = b.schema.get_field_index("n_chars")
            if n >= 0:
                b = b.set_column(n, b.schema.field(n), pa.array([None if t is None else len(t) for t in new]).cast(b.schema.field(n).type))
            yield b
        forget("secrets")
    return docs.mapInArrow(run, docs.schema)
