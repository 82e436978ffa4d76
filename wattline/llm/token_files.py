"""Token-id files (operator 2).

Documents are encoded, given an end id and written in ascending doc_id order
as Parquet with a list column of ids.  The list's encoding (``dictionary`` or
``delta``), the row-group and page sizes are parameters; page indexes are
written, and doc_id is sorted over the files, so a reader that asks for some
doc_ids, or for the metadata columns alone, fetches only those pages.

Order: rows are dealt by ranges of (doc_id, hash of the text) and sorted inside each
range (null ids first, ties by hash, then text), so a doc_id that many rows share spans
several tasks.  The task that writes a file counts ids as it goes and stores with each
document how many come before it in its range (``offset``); ``start`` adds the totals
of the earlier ranges, so it always follows the order of the files.

A text is encoded piece by piece: the tokenizer's normaliser and splitter never
join across ASCII white space, so each distinct piece goes through the
tokenizers library once per worker and its ids are remembered (the memory is
bounded and refilled).  Arrow parts a slice of texts and finds its distinct pieces;
a word of Latin letters goes to the library's model without normaliser and splitter,
which would leave it as it is.  Null and empty texts hold the end id alone; repeated
rows are written as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized_root
from .common import record, slices, texts, worker_state

END_ID = 1
FILES = "doc_id long, n_tokens long, ids array<int>, part int, offset long"
_SEPARATOR = "\x01"       # one id; a text that holds it is encoded whole
_REMEMBERED = 1_000_000   # pieces a worker remembers
_SLICE = 4_000_000        # bytes of text encoded at once
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"   # each lower-cases to one letter, and joins no other character before it
_MARKS = r"[!-&(-/:-@\[-`{-~]*"      # ASCII without the apostrophe: 's and others are words
_PARTS = f"(?s)^(?P<before>{_MARKS})(?P<middle>[{_LETTERS}0-9](?:.*[{_LETTERS}0-9])?)(?P<after>{_MARKS})$"
_END, _NOTHING = 0, 1     # numbers of a text's end and of an empty piece


def _words(pieces: pa.Array) -> pa.Array:
    """Whether each piece is a word of Latin letters."""
    return pc.match_substring_regex(pieces, f"^[{_LETTERS}]+$")


def _mask(of: pa.Array) -> np.ndarray:
    return of.to_numpy(zero_copy_only=False)


def _parts_words(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, makes each run of letters one word, each digit and each run of other
    characters another, and marks the last id of a word: then pieces can be parted (see ``Encoder``)."""
    import json
    of = json.loads(tokenizer.to_str())
    model = of["model"]
    return ([x.get("type") for x in (of["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and of["normalizer"]["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
            and [{k: v for k, v in x.items() if k != "trim_offsets"} for x in (of["pre_tokenizer"] or {}).get("pretokenizers", [])]
            == [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
            and model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not model["continuing_subword_prefix"]
            and not model["dropout"] and of["post_processor"] is None and of["truncation"] is None and of["padding"] is None
            and not any(_mask(_words(pa.array([t["content"] for t in of["added_tokens"]], pa.string())))))


class Encoder:
    """Text to numpy ids through the tokenizers library, remembering pieces.

    Where the tokenizer parts words (``_parts_words``), a word of Latin letters, or an ASCII piece, in another
    case has the lower-cased piece's ids, and a piece between marks has the ids of the leading marks, of what they
    enclose and of the trailing ones, so those need no encoding of their own; a lower-case word goes to the model
    without normaliser and splitter, which would leave it as it is.  A piece that holds an added token (in any case:
    it may match raw text only) is encoded as it is."""

    def __init__(self, path: str, remembered: int = _REMEMBERED):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.added = tuple(t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        sep = self._ids(_SEPARATOR)
        self.separator = sep[0] if len(sep) == 1 else None
        self.parted = _parts_words(self.tokenizer)
        if self.parted:
            from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit
            model = self.tokenizer.model
            self.ascii, self.latin = Tokenizer(model), Tokenizer(model)   # of words that need no normaliser nor splitter
            self.ascii.pre_tokenizer = WhitespaceSplit()
            self.latin.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)      # ids that end a word
            self.last[[k for t, k in vocabulary.items() if t.endswith(model.end_of_word_suffix)]] = True
        self._reset()

    def _ids(self, text: str, tokenizer=None):
        return (tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _reset(self):
        self.known: dict[bytes, int] = {b"": _NOTHING}                    # numbers of pieces
        self.size, self.first = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.int32)
        self.ids[0], self.size[_END], self.used, self.count = END_ID, 1, 1, 2

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Remember pieces by their ids, one after another; their numbers."""
        count, used = self.count + len(sizes), self.used + len(ids)
        if count > len(self.size):
            self.size, self.first = (np.concatenate([x, np.zeros(count, np.int32)]) for x in (self.size, self.first))
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(used, np.int32)])
        self.ids[self.used:used] = ids
        self.size[self.count:count], self.first[self.count:count] = sizes, self.used + np.cumsum(sizes) - sizes
        numbers = np.arange(self.count, count, dtype=np.int32)
        self.count, self.used = count, used
        return numbers

    def _encode_words(self, words: list[str], tokenizer) -> np.ndarray:
        """Numbers of new lower-case words."""
        numbers = []
        for k in range(0, len(words), 512):
            part = words[k:k + 512]
            got = np.array(self._ids(" ".join(part), tokenizer), np.int32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(part) or ends[-1] != len(got):
                raise ValueError("a word's last id does not tell where it ends")
            numbers.append(self._keep(got, np.diff(ends, prepend=0)))
        return np.concatenate(numbers) if numbers else np.zeros(0, np.int32)

    def _encode_pieces(self, pieces: list[str]) -> np.ndarray:
        """Numbers of new pieces."""
        numbers = []
        for k in range(0, len(pieces), 512):
            part = pieces[k:k + 512]
            got = np.array(self._ids(f" {_SEPARATOR} ".join(part)), np.int32)
            cut = np.flatnonzero(got == self.separator)
            if len(cut) != len(part) - 1:
                raise ValueError("the separator's id occurs inside a piece")
            sizes = np.diff(cut, prepend=-1, append=len(got)) - 1
            numbers.append(self._keep(np.delete(got, cut), sizes))
        return np.concatenate(numbers) if numbers else np.zeros(0, np.int32)

    def _numbers(self, pieces: pa.Array, learn) -> np.ndarray:
        """Numbers of distinct pieces; ``learn`` gives those of the unknown ones."""
        keys = pieces.cast(pa.binary()).to_numpy(zero_copy_only=False)
        numbers = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int32, len(keys))
        if len(new := np.flatnonzero(numbers < 0)):
            numbers[new] = learn(pieces.take(pa.array(new)))
            self.known.update(zip(keys[new], numbers[new].tolist()))
        return numbers

    def _learn_parts(self, parts: pa.Array) -> np.ndarray:
        numbers, texts_ = np.empty(len(parts), np.int32), parts.to_numpy(zero_copy_only=False)
        word, is_ascii = (_mask(f(parts)) for f in (_words, pc.string_is_ascii))
        for chosen, encode in ((word & is_ascii, lambda w: self._encode_words(w, self.ascii)),
                               (word & ~is_ascii, lambda w: self._encode_words(w, self.latin)), (~word, self._encode_pieces)):
            numbers[chosen] = encode(texts_[chosen].tolist())
        return numbers

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        if not self.parted:
            return self._encode_pieces(pieces.to_pylist())
        low = pc.ascii_lower(pieces)
        raw = pa.array(np.any([_mask(pc.match_substring(low, a)) for a in self.added] or [np.zeros(len(pieces), bool)], axis=0))
        found = pc.extract_regex(pieces, _PARTS)
        fits = pc.and_not(found.is_valid(), raw)
        before, after = (pc.if_else(fits, pc.struct_field(found, x), "") for x in ("before", "after"))
        middle = pc.if_else(fits, pc.struct_field(found, "middle"), pieces)
        middle = pc.if_else(_words(middle), pc.utf8_lower(middle),
                            pc.if_else(pc.and_not(pc.string_is_ascii(middle), raw), pc.ascii_lower(middle), middle))
        parts = pa.concat_arrays([before, middle, after]).dictionary_encode()
        three = self._numbers(parts.dictionary, self._learn_parts)[parts.indices.to_numpy()].reshape(3, -1)
        numbers = three[1].copy()
        joined = np.flatnonzero((three[0] != _NOTHING) | (three[2] != _NOTHING))
        of = three[:, joined].T
        numbers[joined] = self._keep(self._gather(of.ravel()), self.size[of].sum(1))
        return numbers

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the numbered pieces, one after another."""
        n = self.size[at]
        upto = np.cumsum(n, dtype=np.int64)
        take = np.repeat(self.first[at] - (upto - n).astype(np.int32), n)
        take += np.arange(len(take), dtype=np.int32)
        return self.ids[take]

    def _numbered(self, rows):
        """Numbers of the texts' pieces, where each text's end, how many ids each text has with its end id, and the
        texts to be encoded whole."""
        if len(self.known) > self.remembered:
            self._reset()
        column = rows if isinstance(rows, pa.Array) else pa.array(rows, pa.string())
        skip = pc.match_substring(column, _SEPARATOR) if self.separator is not None else pa.array(np.ones(len(column), bool))
        whole = np.flatnonzero(_mask(skip)).tolist()
        if whole:
            column = pc.if_else(skip, "", column)
        lists = pc.ascii_split_whitespace(column)       # an empty piece beside white space at an end
        pieces = lists.flatten().dictionary_encode()
        at = self._numbers(pieces.dictionary, self._learn)[pieces.indices.to_numpy()]
        ends = np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)
        upto = np.append(0, np.cumsum(self.size[at], dtype=np.int64))[np.append(0, ends)]
        return at, ends, np.diff(upto) + 1, whole

    def encode(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (a list or an Arrow array without nulls) one after another, each with its end id, and their numbers of ids."""
        at, ends, n, whole = self._numbered(rows)
        pa.default_memory_pool().release_unused()
        ids = self._gather(np.insert(at, ends, _END))
        if whole:
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i in whole:
                parts[i] = np.append(np.array(self._ids(str(rows[i])), np.int32), np.int32(END_ID))
                n[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, n

    def lengths(self, rows) -> np.ndarray:
        """The texts' numbers of ids, each with its end id."""
        _, _, n, whole = self._numbered(rows)
        pa.default_memory_pool().release_unused()
        for i in whole:
            n[i] = len(self._ids(str(rows[i]))) + 1
        return n


def encoder(path: str, remembered: int = _REMEMBERED) -> Encoder:
    """The worker's encoder for a tokenizer file and a number of pieces to remember."""
    kept, name = worker_state(), f"{path}/{remembered}"
    if name not in kept:
        kept[name] = Encoder(path, remembered)
    return kept[name]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, encoding: str = "dictionary",
                      row_group_mb: int = 32, page_kb: int = 256) -> None:
    """Encode ``docs`` and write them below ``path`` (columns ``FILES``)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)

    def encode(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
                            ("part", pa.int32()), ("offset", pa.int64())])
        enc, before = encoder(tokenizer), 0
        for b in slices(batches, "text", _SLICE):
            got, n = enc.encode(b.column(b.schema.get_field_index("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(got))
            upto = before + np.cumsum(n)
            yield record(schema, [b.column(b.schema.get_field_index("doc_id")), n, lists,
                                  b.column(b.schema.get_field_index("part")), upto - n])
            before = int(upto[-1])

    # Equal rows may stand in any order among themselves: their place in the input parts them.
    (texts(docs).withColumn("_h", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
     .repartitionByRange("doc_id", "_h", "_row").sortWithinPartitions("doc_id", "_h", "text")
     .select("doc_id", "text", F.spark_partition_id().alias("part"))
     .mapInArrow(encode, FILES)
     .write.option("compression", "zstd")
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.dictionary.page.size", 1 << 20)
     .option("parquet.block.size", row_group_mb << 20)
     .option("parquet.page.size", page_kb << 10)
     .parquet(path))


def read_token_files(spark, path: str, *columns: str) -> DataFrame:
    """The files' rows; a filter on doc_id skips row groups and pages."""
    df = spark.read.schema(FILES).parquet(path)
    return df.select(*columns) if columns else df


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``start``: ids before each document (``part``, ``offset``), over all files, in order."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # one row per range
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("offset"))


def digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    def crc(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("offset", pa.int64()),
                            ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            lists = b.column(b.schema.get_field_index("ids"))
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            yield record(schema, [b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("part")),
                                  b.column(b.schema.get_field_index("offset")), np.diff(at).astype(np.int64),
                                  [zlib.crc32(values[s:e].tobytes()) for s, e in zip(at[:-1], at[1:])]])

    rows = read_token_files(spark, path, "doc_id", "part", "offset", "ids").mapInArrow(
        crc, "doc_id long, part int, offset long, n_tokens long, ids_crc32 long")
    return with_starts(rows, read_token_files(spark, path, "part", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


def scratch_path(spark, name: str = "token-files") -> str:
    return f"{materialized_root(spark)}/{name}-{uuid.uuid4().hex}"
