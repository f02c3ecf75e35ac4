"""The corpus pipeline: toxic documents go, near copies go, benchmark leaks go, then the mix is drawn and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import contamination, hilbert, mixing, simhash, toxicity
from tabulon.session import discard, staged


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, learnt from the labelled ones among them, finds toxic go."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: that with the smallest doc_id."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also a re-parameterised one, go."""
    return contamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: whole documents, up to three times each."""
    return mixing.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``curve``, ``shard`` and ``slot`` along the Hilbert curve."""
    return hilbert.document_shards(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("hilbert_sharding", sharding),
]

#: Classifiers and fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn on ``documents``, each on what the one before has written; that goes when it has been read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
