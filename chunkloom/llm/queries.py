"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import block_names, decontaminate, hmm, ngram_join, packing, quality, secret_scan, sharding, suffixes, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.normalised_pages(_read(spark, sf_dir, "pages"))


def warc_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 held against the pages themselves, which SQL has as well."""
    return warc.payloads(_read(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 held against the documents' words, which SQL has as well."""
    return packing.held(_read(spark, sf_dir, "documents"))


def op5_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model_scores(_read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_duplicates(_read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_read(spark, sf_dir, "documents"))


def sharded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 held against the sources' rows, which SQL has as well."""
    return sharding.held(_read(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_ngram_jaccard_join, op3_warc_normaliser, op4_best_fit_packing, op5_hmm_scores, op6_exact_dedup, op7_secret_scan, op8_sharding, op9_suffix_array_dedup, op10_decontamination,
        warc_payloads, packed_documents, sharded_sources,
    )
}

ORACLE_SQL = {
    "op2_ngram_jaccard_join": ngram_join.SQL, "warc_payloads": warc.SQL, "packed_documents": packing.SQL, "op6_exact_dedup": block_names.SQL, "op7_secret_scan": secret_scan.SQL, "sharded_sources": sharding.SQL, "op9_suffix_array_dedup": suffixes.SQL,
}
