"""Rows without doc_id, several texts of one doc_id, and repeated rows: every operator gives each row its own
result, the same for equal texts; and the whole pipeline on a small folder against plain rules."""

import os
import re
from collections import Counter

import numpy as np
import pytest

from wattline.llm import hmm, merkle, line_runs, pii, secrets, spotsigs, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    out = [(i, text(20)) for i in range(12)]
    out += [(3, "another text of three, mail a@b.org"), (None, "no id, call +1 2345 67890"), (None, None), (None, "")]
    out += [(5, "five times password: hunter2secret")] * 5 + [(None, "no id and twice 0123456789abcdef0123456789abcdef")] * 2
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA).repartition(3)


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_every_row_has_a_result(spark, docs, rows):
    want = Counter(i for i, _ in rows)
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(hmm.score_documents(docs, hmm.held_out_rows(), states=2, iterations=1)) == want
    assert ids(pii.scan_personal_data(docs)) == want
    assert ids(secrets.scan_secrets(docs, None)) == want
    assert ids(spotsigs.compare_with_next(docs, spotsigs.common_words(docs), 4)) == want
    assert ids(merkle.manifest(docs, merkle.every_third())) == want
    assert ids(line_runs.drop_repeated_lines(docs)) == want
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int"))
    assert ids(toxicity.score_documents(docs, model)) == want


def test_equal_texts_have_equal_results(docs):
    scored = counted(hmm.score_documents(docs, hmm.held_out_rows(), states=2, iterations=1).where("doc_id = 5"), "n_tokens", "base_score", "score")
    assert sorted(scored.values()) == [1, 5]
    assert counted(pii.scan_personal_data(docs).where("doc_id is null"), "n_phone") == {(1,): 1, (0,): 4}
    assert counted(secrets.scan_secrets(docs, None).where("doc_id = 5 or doc_id is null"), "n_assign", "n_hex") == {(0, 0): 4, (1, 0): 5, (0, 1): 2}


# -- pipeline ----------------------------------------------------------------------

def folder(spark, path):
    """Toxic documents (a marker word), near copies, benchmark passages, secrets, clean ones, and rows without id."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k:03d}" for k in range(400)]
    item = " ".join(rng.choice(vocabulary, 40))
    rows, toxic, clean = [], [], []
    for i in range(400):
        words = list(rng.choice(vocabulary, int(rng.integers(60, 120))))
        if i % 8 == 0:
            words = [w if k % 3 else "vilefoulword" for k, w in enumerate(words)]
            toxic.append(i)
        else:
            clean.append(i)
        rows.append((i, " ".join(words)))
    base = dict(rows)
    rows += [(1000 + i, base[i] + " tail") for i in clean[:20]]
    rows += [(2000 + i, " ".join(rng.choice(vocabulary, 30)) + " " + item) for i in range(5)]
    rows += [(3000 + i, " ".join(rng.choice(vocabulary, 60)) + f" password: Zx{i}9qLm2Tr{i}") for i in range(5)]
    rows += [(None, " ".join(rng.choice(vocabulary, 70))), (None, None)]
    path = str(path)
    spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, item, set(toxic), clean


def test_pipeline_against_plain_rules(spark, tmp_path):
    import corpus_pipeline
    from wattline.llm.common import stored
    from wattline.llm.packing import LENGTHS
    rows, item, toxic, clean = folder(spark, tmp_path)
    seen, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    schema = docs.schema
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), f"test-{name}")
        seen[name] = docs
        assert name == "best_fit_packing" or [f.name for f in docs.schema] == [f.name for f in schema]
    ids = {name: Counter(r["doc_id"] for r in df.collect()) for name, df in seen.items()}
    every = Counter(i for i, _ in rows)
    assert ids["toxicity"] == Counter({i: n for i, n in every.items() if i not in toxic})
    copies = {1000 + i for i in clean[:20]}
    assert ids["minhash_near_dedup"] == Counter({i: n for i, n in ids["toxicity"].items() if i not in copies})
    assert ids["decontamination"] == Counter({i: n for i, n in ids["minhash_near_dedup"].items() if i is None or not 2000 <= i < 2005})
    assert ids["secret_scan"] == ids["decontamination"]
    before = {r["doc_id"]: r for r in seen["decontamination"].where("doc_id is not null").collect()}
    for r in seen["secret_scan"].where("doc_id is not null").collect():
        if r["doc_id"] >= 3000:
            assert "9qLm2Tr" not in r["text"] and "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == before[r["doc_id"]]["text"]
    packed = seen["best_fit_packing"].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == ids["secret_scan"]
    used = Counter()
    for r in packed:
        used[r["bin_id"]] += r["n_tokens"]
    for r in packed:
        assert used[r["bin_id"]] == r["bin_used"] <= r["bin_capacity"] in LENGTHS
