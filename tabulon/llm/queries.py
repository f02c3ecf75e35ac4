"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import (
    contamination, hilbert, maxscore, mixing, packing, perplexity, quality, reply_trees, simhash, site_templates, toxicity, url_rules, whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judged(pages, url_rules.labelled_urls(pages, table(spark, sf_dir, "labels")))


def op3_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "item_windows", "share", "changed_slots")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.perplexity_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_groups(docs, keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    sharded = hilbert.document_shards(docs, keep=["doc_id"])
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "quota_blocks")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a tree without branches; conversation -1 holds control strings."""
    added = spark.createDataFrame([(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    messages, links = reply_trees.chains(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added))
    paths = reply_trees.ranked_paths(links)
    return reply_trees.digests(reply_trees.formatted_paths(messages, paths))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
