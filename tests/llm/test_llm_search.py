"""Hard negatives, Merkle manifest and line runs against plain versions on small awkward tables."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import hard_negatives as hn
from wattline.llm import line_runs, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars int, leaf string, pos long, h long, keeper long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 7, 9) for r in rows], DOCS)


# -- Merkle manifest ---------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, pos):
    out = []
    for nodes in levels[:-1]:
        run = pos // 8 * 8
        out.append((nodes[run:pos], nodes[pos + 1:run + 8]))
        pos //= 8
    return out


def plain_manifest(rows, tampered):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((plain_leaf(*r), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {}
    for lang in order:
        trees[lang].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        levels[lang] = plain_tree([x[0] for x in trees[lang]])
    top = plain_tree([levels[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for pos, (leaf, r) in enumerate(trees[lang]):
            path = plain_path(levels[lang], pos) + plain_path(top, k)
            value = leaf
            if tampered(r[0]) and r[1] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                value = plain_leaf(r[0], low, *r[2:])
            for left, right in path:
                value = sha("".join(left) + value + "".join(right))
            out.append((r[0], leaf, levels[lang][-1][0], top[-1][0], sha("".join(x for a, b in path for x in a + b)), value, value == top[-1][0]))
    return out


def third(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def check_manifest(spark, rows):
    got = [tuple(r) for r in merkle.manifest(documents(spark, rows).repartition(3), merkle.every_third()).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(plain_manifest(rows, third), key=key)


def test_manifest_of_awkward_rows(spark):
    rows = [(i, f"Text {i} Éß", ("en", "de", None, "Zz")[i % 4], "web" if i % 3 else None, i if i % 5 else None) for i in range(70)]
    rows += [(None, "No Id", "en", "s", 1), (None, None, "en", "s", 1), (3, "Other Text", "en", "s", 2), (9, "", "one", "", 0)]
    rows += [(4, "Twice", "de", "s", 1)] * 3
    check_manifest(spark, rows)


def test_manifest_over_several_passes(spark):
    """More leaves than a block, trees of exactly one block and of one more; more languages than a block."""
    rows = [(i, f"T{i}", "a", "s", 1) for i in range(merkle.BLOCK * 2 + 1)]
    rows += [(i, f"U{i}", "b", "s", 1) for i in range(merkle.BLOCK)]
    rows += [(i, f"V{i}", "c", "s", 1) for i in range(9)]
    rows += [(i, "W", f"lang{i:04d}", "s", 1) for i in range(merkle.BLOCK + 20)]
    check_manifest(spark, rows)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(documents(spark, []), merkle.every_third()).count() == 0
    check_manifest(spark, [(0, "Only", None, None, None)])
    check_manifest(spark, [(5, None, "x", None, None), (6, "B" * 300_000, "y", None, 300_000)])


def test_untampered_rows_verify(spark):
    rows = [(i, "Abc", "en", "s", 3) for i in range(30)]
    assert {r["verified"] for r in merkle.manifest(documents(spark, rows)).collect()} == {True}


# -- line runs ---------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def plain_key(line):
    key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    return key if len(key) >= 40 else None


def plain_lines(rows):
    count, keeper = Counter(), {}
    for doc_id, text in rows:
        for key in {plain_key(x) for x in (text or "").split("\n")} - {None}:
            count[key] += 1
            keeper[key] = max(keeper.get(key, -math.inf), -math.inf if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [count[k] >= 5 and keeper[k] != (-math.inf if doc_id is None else doc_id) if (k := plain_key(x)) else False for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc_id, len(lines), sum(gone), sha(kept)))
    return out


LONG = "The Terms of Service apply to all of this page and the rest"
LINES = [LONG, f"\t {LONG.upper()} \r", LONG.lower() + "\x0b", "É" * 40, "é" * 40, "É" * 39, "x" * 40, "Y" * 41 + " ", "  ", "", "short",
         "a line that is found in four documents only, not more", "\xa0" + "z" * 40]


def line_rows():
    rng = np.random.default_rng(4)
    rows = [(i, "\n".join(rng.choice(LINES[:11], rng.integers(0, 12)))) for i in range(-20, 30)]
    rows += [(100 + i, LINES[11]) for i in range(4)]
    rows += [(None, LONG), (None, LONG + "\n" + "only without ids, in documents that have none of them"), (7, LONG), (7, "x" * 40), (None, None), (8, "")]
    rows += [(None, "only without ids, in documents that have none of them")] * 5
    rows += [(1 << 62, LONG + "\n" + "k" * 50), (-(1 << 62), "k" * 50)] + [(50, "\n".join(["k" * 50] * 3))] * 3
    rows += [(60, "\n".join([LONG] * 5000)), (61, "q" * 200_000)]
    return rows


def test_line_runs_against_plain_version(spark):
    rows = line_rows()
    docs = documents(spark, [(i, t, None, None, None) for i, t in rows]).repartition(4)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = sorted(plain_lines(rows), key=key)
    assert sum(r[2] for r in want) > 100
    for batches in (1, 4, 7):
        got = [tuple(r) for r in line_runs.digests(line_runs.drop_repeated_lines(docs, batches=batches)).collect()]
        assert sorted(got, key=key) == want


def test_line_runs_of_an_empty_table(spark):
    assert line_runs.drop_repeated_lines(documents(spark, [])).count() == 0


def test_runs_give_what_is_new_and_stay_few(spark):
    runs = line_runs.LineRuns(spark)
    batches = [[(9, 1), (9, 2), (8, 1)], [(7, 1), (7, 3)], [(6, 3), (6, 4)], [(5, 4), (5, 1), (4, 5)], [], [(1, 5), (1, 6)]]
    fresh = [sorted((r["h"], r["n"], r["keeper"]) for r in runs.add(
        spark.createDataFrame([(d, h, 0) for d, h in b], "doc_id long, h long, g long")).collect()) for b in batches]
    assert fresh == [[(1, 2, 9), (2, 1, 9)], [(3, 1, 7)], [(4, 1, 6)], [(5, 1, 4)], [], [(6, 1, 1)]]
    assert sorted(runs.levels) == [1, 2]
    assert sorted((r["h"], r["n"], r["keeper"]) for r in runs.compact().collect()) == [
        (1, 4, 9), (2, 1, 9), (3, 2, 7), (4, 2, 6), (5, 2, 4), (6, 1, 1)]


def test_runs_join_without_a_shuffle(spark):
    runs = line_runs.LineRuns(spark)
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"), F.col("id").alias("g"))
    a = runs._write(rows.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")))
    b = runs._write(runs.run(a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs.run(a).join(runs.run(b).select("h", "g"), ["h", "g"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


# -- hard negatives ----------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, ids long, chunk string, best int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2) for r in rows], VECTORS)


def plain_negatives(rows):
    own = {}
    for vec_id, v, label in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        own.setdefault(vec_id, []).append((label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = set()
    for a, versions in own.items():
        if a % 50:
            continue
        for label, q in versions:
            scored = {True: {}, False: {}}
            for i, others in own.items():
                for lab, v in others:
                    if i != a and len(v) == len(q):
                        s = max(-hn._LONG, min(hn._LONG, sum(x * y for x, y in zip(q, v))))
                        scored[lab == label][i] = max(s, scored[lab == label].get(i, -math.inf))
                        scored[lab == label].setdefault(("all", i), []).append(s)
            best = sorted((-s, i) for i, s in scored[True].items() if not isinstance(i, tuple))[:5]
            for lost, i in best:
                fits = sorted((-max(f), j[1]) for j, s in scored[False].items() if isinstance(j, tuple)
                              and (f := [x for x in s if -50 * lost <= 100 * x <= -95 * lost]))
                out |= {(a, i, r + 1, j, -lost, -n) for r, (n, j) in enumerate(fits[:3])}
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hn.mine(df).collect())


def test_hard_negatives_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0.4, 1, 24).astype(np.float32)], int(rng.integers(0, 4))) for i in range(420)]
    rows += [(500, rows[3][1], 1), (501, rows[3][1], 1), (502, rows[3][1], 2), (503, rows[3][1], 1)]  # ties
    rows += [(600, None, 1), (601, [1.0] * 24, None), (None, [1.0] * 24, 1), (602, [math.nan] * 24, 1), (603, [math.inf] + [1.0] * 23, 1),
             (604, [None] + [1.0] * 23, 1), (650, [], 1), (651, [], 2), (652, [1.0], 1), (700, [0.0] * 24, 3), (701, [-1.0] * 24, 3)]
    rows += [rows[5], rows[100], (6, [2.0] * 24, 1), (750, [3e30] * 24, 1), (751, [2e30] * 24, 1), (752, [1.5e30] * 24, 2)]
    want = plain_negatives(rows)
    assert len(want) > 50
    assert mined(vectors(spark, rows).repartition(3)) == want


def test_hard_negatives_of_an_empty_table(spark):
    assert hn.mine(vectors(spark, [])).count() == 0


def test_hard_negatives_over_several_chunks_equal_the_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, (10, 70))
    rows = []
    for i in range(2500):
        lab = int(rng.integers(0, 10)) if i % 3 else 4
        rows.append((i, [float(x) for x in (centre[lab] + rng.normal(0, 1.2, 70)).astype(np.float32) / 8], lab))
    df = vectors(spark, rows)
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings/*.parquet')")
    assert mined(spark.read.parquet(str(tmp_path / "embeddings")).repartition(4)) == sorted(con.execute(hn.ORACLE).fetchall())


def test_anchors_meet_rows_without_a_join_or_broadcast(spark, monkeypatch):
    """The anchors' copies for the tasks were estimated at their size in the stored file and broadcast through the driver."""
    plans = []
    write = hn.stored
    monkeypatch.setattr(hn, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0.4, 1, 24).astype(np.float32)], i % 3) for i in range(300)]
    far = hn._best_rows(hn.chunks_of(hn.prepared(vectors(spark, rows)), 64), hn.prepared(vectors(spark, rows)).select(
        "vec_id", "label", "v", F.col("vec_id").alias("anchor"), F.array(F.lit(-hn._LONG)).alias("low"), F.array(F.lit(hn._LONG)).alias("high")), 5, True)
    assert far.count() == 300
    plans.append(("met", far._jdf.queryExecution().executedPlan().toString()))
    assert not any("Join" in plan or "Broadcast" in plan for _, plan in plans)


@pytest.mark.parametrize("held, down, across", [(16, 5, 5), (8, 2, 9), (1000, 8, 1)])
def test_hard_negatives_over_a_grid(spark, monkeypatch, held, down, across):
    rng = np.random.default_rng(held)
    rows = [(i, [float(x) for x in rng.normal(0.4, 1, 12 if i % 5 else 3).astype(np.float32)], int(rng.integers(0, 4))) for i in range(0, 3000, 5 if held > 99 else 10)]
    rows += [(i, [float(x) * 1e12 for x in rng.normal(0.4, 1, 12).astype(np.float32)], int(rng.integers(0, 4))) for i in range(4000, 4100, 5)]
    rows += [(i, [math.floor(x) * 40.0 for x in rng.normal(0.4, 3, 12)], 1) for i in range(5001, 5040)]  # many ties, other types
    monkeypatch.setattr(hn, "ANCHORS", 4)
    monkeypatch.setattr(hn, "_HELD", held)
    monkeypatch.setattr(hn, "_TILE", 3)
    monkeypatch.setattr(hn, "_grid", lambda *a: (down, across))
    chunked = hn.chunks_of
    monkeypatch.setattr(hn, "chunks_of", lambda df: chunked(df, 16))
    want = plain_negatives(rows)
    assert len(want) > 50
    assert mined(vectors(spark, rows).repartition(3)) == want


@pytest.mark.parametrize("chunks, rows, blocks, anchors, tasks", [
    (0, 0, 0, 0, 12), (1, 3, 1, 1, 200), (1202, 615384, 14, 12308, 25), (1202, 615384, 14, 12308, 600), (4, 2000, 3, 2000, 200),
    (60000, 30_000_000, 700, 600_000, 200)])
def test_the_grid_follows_the_tables(chunks, rows, blocks, anchors, tasks):
    down, across = hn._grid(chunks, rows, blocks, anchors, tasks)
    assert 1 <= down <= max(1, chunks) and 1 <= across <= max(1, blocks)
    assert down * across >= min(tasks, chunks * blocks)
    assert anchors / across <= hn._HELD or across == blocks
    assert down * across <= tasks + across  # copies of a block do not grow with the table


def test_best_rows_count_an_id_once():
    rng = np.random.default_rng(9)
    best, all_rows = hn._Best(6, 3), {}
    for _ in range(40):
        n = int(rng.integers(1, 30))
        slot, score, ids = rng.integers(0, 6, n), rng.integers(-9, 9, n), rng.integers(0, 12, n)
        best.add(slot, score, ids)
        for k, s, i in zip(slot.tolist(), score.tolist(), ids.tolist()):
            mine = all_rows.setdefault(k, {})
            mine[i] = max(s, mine.get(i, s))
        for k in range(6):
            want = sorted((-s, i) for i, s in all_rows.get(k, {}).items())[:3]
            assert [(-s, i) for s, i in zip(best.score[k].tolist(), best.ids[k].tolist())][:best.count[k]] == want
            assert best.floor[k] == (-want[2][0] if len(want) == 3 else -math.inf)


@pytest.mark.parametrize("most", [200, 40_000, 1 << 24, 1 << 40])
def test_packed_rows_come_back(most):
    rows = np.array([[-most, 3, most], [0, 1, -1]], float)
    back = hn._ints(hn._packed(rows), 2, 3)
    assert back.tolist() == rows.tolist() and (back.dtype == object) == (most >= hn._SMALL)


@pytest.mark.parametrize("dim", [1, 7, 64, 100])
def test_intervals_hold_the_exact_score(dim):
    rng = np.random.default_rng(dim)
    q, v = rng.integers(-900, 900, (40, dim)), rng.integers(-900, 900, (300, dim))
    v[0], q[0], v[1] = 0, 0, q[1]
    low, high = hn.intervals(hn.planes(q), *hn.encode(v))
    score = q @ v.T
    assert (low <= score).all() and (score <= high).all()
    if dim == 64:
        wide = 2 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
        assert ((high - low)[1:, 1:] < 0.75 * wide[1:, 1:]).mean() > 0.95
