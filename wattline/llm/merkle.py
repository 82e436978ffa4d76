"""Merkle manifest of a data set (operator 12), by time-forward processing.

Every row is a leaf.  A tree stands over the leaves of each language, in ascending
order of doc_id, with eight children to a node; another such tree over the roots of
the languages ends in one root.

Nodes are labelled (last leaf below, height), so children come before their parent.
Up: nodes are visited by rising label, and a priority queue keyed by the parent's label
hands each digest on to the parent, which is hashed when the sweep reaches it.  Down: the
labels are visited in reverse, and the queue hands every node the siblings on its way to
the root (its proof suffix), to which it adds its own.

The queue is external.  A tree is cut into blocks of ``BLOCK`` neighbouring nodes, whole
subtrees of three levels; Spark's shuffle sorts nodes and messages by (tree, block,
label) and so delivers them, and the queue of one task holds at most one block.  The
roots of the blocks are the leaves of the next pass, so a pass shrinks the table 512
times, and no tree, language or level is ever gathered in one place.

Digests are lowercase hex of SHA-256; inputs are concatenated, digests as hex text.

Defined results: nulls in any field are part of the leaf (``-``); rows without doc_id
come first; rows of one doc_id are ordered by leaf, and equal rows are interchangeable;
rows without language form a tree of their own; a lone leaf is its language's root, and a
lone language's root is the root; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, record, stored

FANOUT = 8
LEVELS = 3                    # levels of a block
BLOCK = FANOUT ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TYPES = {"doc_id": "long", "n_chars": "long"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """A row's digest from its fields, each as byte count, colon and value (``-``: null)."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
             for c in (fields[name].cast("string") for name in FIELDS)]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree, doc_id, leaf and changed: the leaf with A-Z of the text lower-cased where
    ``tampered`` (a condition on doc_id) holds, else null.

    ``tree`` names the language so that its byte order puts null first."""
    d = docs.select(*[F.col(c).cast(_TYPES.get(c, "string")).alias(c) for c in FIELDS])
    fields = {c: F.col(c) for c in FIELDS}
    changed = leaf_digest({**fields, "text": F.translate(F.col("text"), _UPPER, _LOWER)})
    tampered = F.lit(False) if tampered is None else tampered
    return d.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), "doc_id",
                    leaf_digest(fields).alias("leaf"), F.when(tampered, changed).alias("changed"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``pos`` (from 0, in ``order`` within ``tree``) and ``n`` (rows of the tree).

    Rows are dealt by ranges, so a large tree spans many tasks; a range counts its
    own rows and starts from the counts of the ranges before."""
    wide = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = (wide.repartitionByRange("tree", *order, "_row").sortWithinPartitions("tree", *order).drop("_row")
             .withColumn("_part", F.spark_partition_id()))

    def count(batches):
        tree, at = None, 0
        for b in batches:
            inside = []
            for t in b.column(b.schema.get_field_index("tree")).to_pylist():
                tree, at = (tree, at + 1) if t == tree else (t, 0)
                inside.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(inside, pa.int64())], [*b.schema.names, "_inside"])

    dealt = stored(dealt.mapInArrow(count, T.StructType([*dealt.schema, T.StructField("_inside", T.LongType())])), name)
    sizes = dealt.groupBy("tree", "_part").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("tree")
    starts = sizes.select("tree", "_part", F.sum("_n").over(whole).alias("n"), F.coalesce(F.sum("_n").over(
        whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (dealt.join(starts, ["tree", "_part"]).withColumn("pos", F.col("_before") + F.col("_inside"))
            .drop("_part", "_inside", "_before"))


def _height(n: int) -> int:
    """Levels above ``n`` nodes inside one block."""
    height = 0
    while n > 1 and height < LEVELS:
        n, height = -(-n // FANOUT), height + 1
    return height


def _label(pos: int, height: int, n: int) -> tuple[int, int]:
    """Label of the node ``height`` levels above ``pos`` in a row of ``n``."""
    width = FANOUT ** height
    return min((pos // width + 1) * width, n) - 1, height


def _up(batches):
    """Forward sweep over whole blocks in label order: the digest of each block's root."""
    out = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    queue: list[tuple[int, int, int, str]] = []  # parent's label, child's last leaf, child's digest
    for rows in batches_of(batches, "tree", "pos", "n", "digest"):
        done = []
        for tree, pos, n, value in zip(*rows):
            top = _height(n)
            heapq.heappush(queue, (*_label(pos, 1, n), pos, value))
            while queue and queue[0][0] == pos:
                height, children = queue[0][1], []
                while queue and queue[0][:2] == (pos, height):
                    children.append(heapq.heappop(queue)[3])
                value = digest("".join(children))
                if height == top:
                    done.append((tree, pos // BLOCK, -(-n // BLOCK), value))
                else:
                    heapq.heappush(queue, (*_label(pos, height + 1, n), pos, value))
        yield record(out, list(zip(*done)) or [[]] * 4)


def blocks(nodes: DataFrame) -> DataFrame:
    """Nodes with their block, dealt and sorted so that a block is whole in one task."""
    dealt = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def passes(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The given nodes (tree, pos, n, digest) and those of every pass up to the roots.
    A pass holds the trees that the pass before did not finish; n = 1 is a finished one."""
    found = [nodes]
    while found[-1].where("n > 1").limit(1).count():
        found.append(stored(blocks(found[-1].where("n > 1").select("tree", "pos", "n", "digest"))
                            .select("tree", "pos", "n", "digest")
                            .mapInArrow(_up, "tree string, pos long, n long, digest string"), name))
    return found


def roots(found: list[DataFrame]) -> DataFrame:
    """tree, digest of its root, and the pass that finished it."""
    out = None
    for k, nodes in enumerate(found):
        here = nodes.where("n = 1").select("tree", "digest", F.lit(k).alias("finished"))
        out = here if out is None else out.unionByName(here)
    return out


def _paths(values: list[str], n: int, above: str):
    """Reverse sweep over one block: (index, path) of its nodes, from the last to the first.

    A path lists the levels from the node's to the root, each as the digests left of it,
    a dot, those right of it, and a bar; ``above`` is the path of the block's root."""
    top = _height(n)
    at = [values]
    for _ in range(top):
        at.append([digest("".join(at[-1][i:i + FANOUT])) for i in range(0, len(at[-1]), FANOUT)])
    # Labels turned round: the last leaf first, parents before children.
    queue = [(-(len(values) - 1), -top, 0, above)]
    while queue:
        _, height, index, path = heapq.heappop(queue)
        height = -height
        if height == 0:
            yield index, path
            continue
        begin = index * FANOUT
        children = at[height - 1][begin:begin + FANOUT]
        for k in range(len(children)):
            last = min((begin + k + 1) * FANOUT ** (height - 1), len(values)) - 1
            heapq.heappush(queue, (-last, 1 - height, begin + k,
                                   f"{''.join(children[:k])}.{''.join(children[k + 1:])}|{path}"))


def _delivered(batches, columns: list[str]):
    """Blocks of rows sorted by (tree, block, pos), each with the message that leads it (pos -1)."""
    key, message, rows = None, None, []
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)):
            if row[:2] != key:
                if rows:
                    yield message, rows
                key, message, rows = row[:2], None, []
            if row[2] < 0:
                message = row
            else:
                rows.append(row)
    if rows:
        yield message, rows


_COLUMNS = ["tree", "block", "pos", "n", "digest", "path", "subroot", "root"]
MESSAGE = "tree string, block long, path string, subroot string, root string"


def _down_columns(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes and the messages to their blocks, sorted by label."""
    lead = messages.withColumn("pos", F.lit(-1).cast("long"))
    both = (nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).unionByName(lead, allowMissingColumns=True))
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _down(batches):
    """Reverse sweep of a pass: messages to the blocks of the pass below."""
    out = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string())])
    for message, rows in _delivered(batches, _COLUMNS):
        found = [(rows[i][0], rows[i][2], path) for i, path in
                 _paths([r[4] for r in rows], rows[0][3], message[5])]
        trees, at, path = zip(*found)
        yield record(out, [trees, at, path, [message[6]] * len(at), [message[7]] * len(at)])


def suffixes(found: list[DataFrame], starts: DataFrame, name: str) -> DataFrame:
    """Messages (``MESSAGE``) to the blocks of the first pass; ``starts`` has one for each
    root (tree, finished, path, subroot, root)."""
    def to_roots(k):
        return starts.where(F.col("finished") == k).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")

    messages = to_roots(len(found) - 1)
    for k in range(len(found) - 2, -1, -1):
        if k:  # to the nodes of pass k, which are the blocks of pass k - 1
            delivered = _down_columns(found[k].where("n > 1").select("tree", "pos", "n", "digest"), messages)
            messages = stored(delivered.select(*_COLUMNS).mapInArrow(_down, MESSAGE), name)
        messages = messages.unionByName(to_roots(k))
    return messages


def fold(value: str, path: str) -> str:
    """The root that a leaf and its path lead to."""
    for level in path.split("|")[:-1]:
        left, right = level.split(".")
        value = digest(left + value + right)
    return value


def _leaf_rows(batches):
    """Reverse sweep into the leaves: the columns of ``manifest``."""
    out = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                     ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
    for message, rows in _delivered(batches, [*_COLUMNS, "doc_id", "changed"]):
        found = list(_paths([r[4] for r in rows], rows[0][3], message[5]))
        folded = [fold(rows[i][9] or rows[i][4], path) for i, path in found]
        yield record(out, [[rows[i][8] for i, _ in found], [rows[i][4] for i, _ in found], [message[6]] * len(found),
                           [message[7]] * len(found),
                           [digest(path.replace(".", "").replace("|", "")) for _, path in found], folded,
                           [f == message[7] for f in folded]])


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256 (digest of the
    siblings on the way to the root) and, with the leaf recomputed from the tampered row
    where ``tampered`` holds, folded_root and verified."""
    placed = stored(numbered(leaves(docs, tampered), ["doc_id", "leaf"], "merkle-leaves")
                    .select("tree", "pos", "n", F.col("leaf").alias("digest"), "doc_id", "changed"), "merkle-placed")
    found = passes(placed, "merkle-nodes")
    subroots = stored(roots(found), "merkle-subroots")
    # The tree over the languages: the same sweeps, with the languages as leaves.
    top = stored(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", "finished"),
                          ["name"], "merkle-languages"), "merkle-top")
    above = passes(top, "merkle-above")
    start = roots(above).select("tree", "finished", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"),
                                F.col("digest").alias("root"))
    to_top = suffixes(above, start, "merkle-suffixes")
    columns = ["tree", "pos", "n", "digest", "name", "finished"]
    schema = "tree string, finished int, path string, subroot string, root string"

    def into_languages(batches):
        out = pa.schema([("tree", pa.string()), ("finished", pa.int32()), ("path", pa.string()), ("subroot", pa.string()), ("root", pa.string())])
        for message, rows in _delivered(batches, [*_COLUMNS, "name", "finished"]):
            paths = list(_paths([r[4] for r in rows], rows[0][3], message[5]))
            yield record(out, [[rows[i][8] for i, _ in paths], [rows[i][9] for i, _ in paths], [p for _, p in paths],
                               [rows[i][4] for i, _ in paths], [message[7]] * len(paths)])

    starts = stored(_down_columns(top.select(*columns), to_top).mapInArrow(into_languages, schema), "merkle-starts")
    to_leaves = suffixes(found, starts, "merkle-suffixes")
    return _down_columns(placed, to_leaves).mapInArrow(
        _leaf_rows, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def every_third() -> Column:
    """Rows whose unsigned crc32 of the decimal doc_id is divisible by 3 (not those without one)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))


# crc32 bit by bit, lists of digests level by level, and one fold step for each level.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, lang, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
      string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda k: CAST((ascii(ch) >> CAST(k AS INTEGER)) & 1 AS BIGINT))))),
      lambda acc, bit: xor(acc >> 1, CASE WHEN xor(acc, bit) & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)) AS c,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
      || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low
  FROM documents),
l AS (SELECT doc_id, lang, sha256(head || body) AS leaf,
        CASE WHEN coalesce(xor(c, 4294967295) % 3 = 0, false) THEN sha256(head || low) ELSE sha256(head || body) END AS given,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS pos FROM d),
up(tree, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM l GROUP BY lang
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], '')))
  FROM up WHERE len(nodes) > 1),
sub AS (SELECT tree, level, nodes[1] AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM up WHERE len(nodes) = 1),
above(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], '')))
  FROM above WHERE len(nodes) > 1),
steps AS (
  SELECT sub.tree, false AS whole, up.level AS step, up.level AS level, up.nodes FROM up JOIN sub ON sub.tree IS NOT DISTINCT FROM up.tree WHERE len(up.nodes) > 1
  UNION ALL
  SELECT sub.tree, true, sub.level + above.level, above.level, above.nodes FROM above, sub WHERE len(above.nodes) > 1),
walk(doc_id, tree, leaf, pos, step, value, proof) AS (
  SELECT doc_id, lang, leaf, pos, 0, given, '' FROM l
  UNION ALL
  SELECT doc_id, tree, leaf, pos, step + 1, sha256(lefts || value || rights), proof || lefts || rights FROM (
    SELECT w.*, array_to_string(s.nodes[run * 8 + 1:i], '') AS lefts, array_to_string(s.nodes[i + 2:run * 8 + 8], '') AS rights FROM (
      SELECT w.*, i // 8 AS run FROM (
        SELECT w.*, CASE WHEN s.whole THEN sub.pos ELSE w.pos END // CAST(pow(8, s.level) AS BIGINT) AS i
        FROM walk w JOIN steps s ON s.step = w.step AND s.tree IS NOT DISTINCT FROM w.tree JOIN sub ON sub.tree IS NOT DISTINCT FROM w.tree) w) w
    JOIN steps s ON s.step = w.step AND s.tree IS NOT DISTINCT FROM w.tree)),
top AS (SELECT nodes[1] AS root, level FROM above WHERE len(nodes) = 1)
SELECT w.doc_id, w.leaf, sub.subroot, top.root, sha256(w.proof) AS proof_sha256, w.value AS folded_root, w.value = top.root AS verified
FROM walk w JOIN sub ON sub.tree IS NOT DISTINCT FROM w.tree, top WHERE w.step = sub.level + top.level
"""
