"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from wicker.llm import packing, quality, secret_spans, simhash, toxicity
from wicker.llm.common import checkpoint_folder, read_table
from wicker.llm.queries import vocabulary

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least one half stay. The fit takes labelled rows of docs that aren't held out."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model, *DOCUMENTS).where("score >= 0.5").select(*DOCUMENTS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.7 stay."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, *DOCUMENTS).where("score < 0.7").select(*DOCUMENTS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id. Texts differ where their doc_ids are
    equal or null: groups are of rows, not of doc_ids."""
    return simhash.representatives(docs).select(*DOCUMENTS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by <secret>, and n_chars counts the new text."""
    found = secret_spans.scan(docs, secret_spans.fit_markov(secret_spans.labelled_strings(spark, docs)))
    text = F.when(F.size("spans") > 0, secret_spans.redacted()).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", "n_chars", F.size("spans").alias("k")).select("doc_id", "text", "lang", "source", F.when(F.col("k") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", one_of_each_group), ("secrets", without_secrets), ("packing", packed)]

#: Fitted scores, XXH64 fingerprints and a tokenizer are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one keeps is written as Parquet under the checkpoint folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
