"""The queries of this package, with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, license_scan, mixing, prefix_forest, secret_scan, substring_dedup, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: five-word shingles, similarity 0.75."""
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), 5, 75)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; sources weigh 5, 2, 1, repeating."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text without repeated passages, and what was removed, of every document."""
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and verified template spans of every document."""
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, by a model of documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a benchmark item's template stands in each document, and which items do."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every row whose vec_id is divisible by 100."""
    return prefix_forest.nearest(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, by a model of labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base secrets, a digest of their spans, and all spans, of every document."""
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.joined(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document under the public 50k byte-level vocabulary."""
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other, over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    """By name, the ten operators' queries and the pipeline."""
    own = (op1_ngram_jaccard_join, op2_mix_sources, op3_substring_dedup, op4_license_scan, op5_language_id, op6_decontaminate, op7_nearest_neighbours, op8_toxicity, op9_secret_scan, op10_token_counts, pipeline)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by name. None of these methods is expressible over whole tables; tests/llm compare with brute force."""
    return {}
