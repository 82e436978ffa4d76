"""Registered queries of this folder's operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, hmm, line_runs, merkle, minhash, packing, pii, secrets, spotsigs, token_files, tool_calls, toxicity
from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"), hmm.held_out_rows())


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.scratch_path(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.digests(spark, path)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_personal_data(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spotsigs.compare_with_next(docs, spotsigs.common_words(docs), ranges)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(packing.token_lengths(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_secrets(docs, secrets.fit(docs))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    return toxicity.score_documents(docs, model).select(
        "doc_id", (toxicity.crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages")


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    calls, results = tool_calls.traffic(conversations)
    return tool_calls.link_tool_calls(conversations.where("role is null or role <> 'assistant'"), calls, results, tool_calls.SCHEMAS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.every_third())


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digests(line_runs.drop_repeated_lines(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_hidden_markov, op2_token_files, op3_personal_data, op4_decontamination, op5_spotsigs,
                                    op6_best_fit, op7_secrets, op8_minhash, op9_toxicity, op10_tool_calls,
                                    op11_hard_negatives, op12_merkle_manifest, op13_line_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontaminate.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE,
            "op12_merkle_manifest": merkle.ORACLE,
            "op13_line_runs": line_runs.ORACLE}
