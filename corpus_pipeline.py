"""The corpus pipeline: quality rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as Parquet and read
again as the next one's docs. The last stage returns pieces of sequences, the others the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studyloom.llm import minhash_dedup, packing, quality_rules, secret_scan, substring_dedup
from studyloom.llm.common import dropped, durable

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("secret scans", secrets),
    ("packing", pack),
]

#: Consistent sampling, byte-pair merging and index-driven packing are beyond SQL; tests hold the rows to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has read goes when it is
    written, the last table when the driver's JVM ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return docs
