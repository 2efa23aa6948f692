"""A training corpus from documents: language, near duplicates, decontamination, secrets, mixture."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import _shared, decontaminate, jaccard_join, language_id, mixing, secret_scan


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without letters or with a score under 0.3 go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.75, smallest doc_id."""
    return jaccard_join.one_per_component(docs, 5, 75)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor its template with other values."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of every document."""
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language ID", identified), ("near duplicates", unlike), ("decontamination", uncontaminated), ("secrets", without_secrets), ("mixture", mixed)]

#: No stage but the last has a SQL form over whole tables; tests/llm compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet in the shared checkpoint folder and read again.

    A stage's table goes once the next one is written; the last one, which the result reads, stays. Null and empty texts go
    at the first stage; rows with a null doc_id and repeated rows are treated as each stage says.
    """
    folder = f"{_shared.ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _shared.remove(spark, f"{folder}/{i - 1}")
    return docs
