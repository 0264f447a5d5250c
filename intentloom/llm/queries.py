"""Queries over the driver's tables: one for each operator, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import latent_search, line_frequency, ngram_jaccard, packing, secrets, sharding, suffix_array, super_kmers, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_latent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_search.latent_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_frequency_rules(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.suffix_array_repeats(_table(spark, sf_dir, "documents"))


def op10_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_kmers.super_kmer_repeats(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_latent_search": op5_latent_search,
    "op6_line_frequency": op6_line_frequency,
    "op7_packing": op7_packing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_suffix_array": op9_suffix_array,
    "op10_super_kmers": op10_super_kmers,
}
ORACLES: dict[str, str] = {
    "op1_sharding": sharding.SQL,
    "op6_line_frequency": line_frequency.SQL,
    "op8_ngram_jaccard": ngram_jaccard.SQL,
    "op9_suffix_array": suffix_array.SQL,
    "op10_super_kmers": super_kmers.SQL,
}
