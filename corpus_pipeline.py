"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, subword encoding.

Each stage reads what its predecessor wrote. Rejected, repeated and near-repeated documents go, documents are taken as
often as the mix says, and the last stage returns sampled segmentations of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosscut.llm import exact_dedup, langid, lsh_forest, mixing, subword
from crosscut.llm.common import scratch
from crosscut.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose best language is ambiguous and has under half the probability."""
    return langid.keep_identified(docs, langid.fit_on(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return lsh_forest.drop_near(docs, k=5, threshold=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """id, sample, ids, log_prob and log_inclusion of two sampled segmentations of each document."""
    return subword.encode_best(docs, tokenizer_path("piece_bpe_32k.model"), k=2).withColumnRenamed("id", "doc_id")


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near-dedup", near), ("mixing", mix), ("encoding", encode)]

#: SQL can't express the language model, the forest or the sampler; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
