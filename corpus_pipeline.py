"""Corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept.  Stages 1 to 3 drop rows (toxic documents; all but one document of each group
of near-duplicates; contaminated documents), stage 4 keeps all rows and masks their
secrets, the last packs the documents and returns one row per piece with its bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm import decontaminate, minhash, packing, secrets, toxicity
from wattline.llm.common import stored, table
from wattline.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and keep what scores below 0.3."""
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard of at least 0.8; the smallest doc_id of a group stays."""
    return minhash.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words of the benchmark that cover at least 5 % of a document."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs, secrets.fit(docs))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(packing.token_lengths(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_documents),
]

# The classifier, the CRF and best-fit packing have no SQL form; tests/llm checks
# each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
