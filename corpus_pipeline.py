"""The corpus pipeline: STAGES over documents, each written as Parquet and reread as the next one's input.

Every stage works on all that its predecessor kept. All but the last return the columns of documents.
SQL can't express decontamination (a randomised SVD), the secret scan (a trained network) or packing (byte-pair
encoding), so ORACLE_SQL is None and tests/llm holds run() against brute-force versions of the stages.

Defined results: columns of documents other than the five are left out by the first stage, whatever their names. A null or empty text passes all filters and
gives its separator alone; texts of any length are taken whole. Of repeated rows with words one stays; repeated rows without words all stay. A row without
doc_id is compared like any other, and stays only if its class has no row with an id; decontamination leaves it in, as it reports ids; its windows have null
in doc_ids. An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intentloom.llm import latent_search, line_frequency, ngram_jaccard, packing, scratch, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a host share go, and documents of which too little remains."""
    return line_frequency.line_frequency_rules(docs).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return ngram_jaccard.keep_one(docs.select(COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or paraphrased, go; rows without doc_id stay."""
    leaks = latent_search.latent_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = leaks.select(leaks["doc_id"].alias("_leaked")).distinct()
    return docs.join(leaks, docs["doc_id"] == leaks["_leaked"], "left_anti").select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret in them is replaced with a mark."""
    return secrets.redact(docs.select(COLUMNS)).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens over all that is left."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.materialise(stage(spark, docs, sf_dir), name)
    return docs
