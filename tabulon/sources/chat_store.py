"""Stored chat tables: Parquet folders with fixed schemas, one per save (see ``manifest``).

A save writes the chats it brings, whatever the store holds, and reads only the buckets these chats lie in. Readers take each
chat from its latest save. :func:`compact_store` merges the folders of buckets that have many, :func:`compact` writes a new store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.conversations import upsert_chats
from tabulon.sources import manifest
from tabulon.sources.manifest import read_or_empty  # noqa: F401

CHATS = "chat_id bigint, title string, source_name string, created_at timestamp, updated_at timestamp, autosaved boolean"
MESSAGES = "chat_id bigint, turn bigint, role string, content string, figure_b64 string"


def write_new_version(df: DataFrame, path: str) -> None:
    """A changed table goes to a new folder: the old one is still being read while it is built,
    and stays whole if the job is lost."""
    df.write.mode("errorifexists").parquet(path)


def append_save(rows: DataFrame, path: str, save: int, removed: DataFrame | None = None) -> None:
    """Store ``rows`` (with ``chat_id``) as save number ``save``; the chats of ``removed`` are gone from then on.

    A repeated save replaces itself.
    """
    marked = rows.withColumn("removed", F.lit(False))
    if removed is not None:
        marked = marked.unionByName(removed.select("chat_id").distinct().withColumn("removed", F.lit(True)), allowMissingColumns=True)
    manifest.append(marked, path, save)


def _latest(stored: DataFrame) -> DataFrame:
    """The rows of every chat's latest save."""
    latest = stored.groupBy("chat_id").agg(F.max(F.struct("number", "attempt")).alias("latest"))
    return stored.join(latest, "chat_id").where("number = latest.number AND attempt = latest.attempt").drop("latest")


def current(spark: SparkSession, path: str, schema: str, chats: DataFrame | None = None) -> DataFrame:
    """The rows of every chat's latest save, without removed chats; with ``chats`` only these chats, from their buckets."""
    stored = manifest.read(spark, path, f"{schema}, removed boolean", chats)
    if chats is not None:
        stored = stored.join(chats.select("chat_id").distinct(), "chat_id", "left_semi")
    return _latest(stored).where("NOT removed").drop("number", "attempt", "removed")


def current_chat(spark: SparkSession, path: str, schema: str, chat_id: int) -> DataFrame:
    """The rows of one chat."""
    return current(spark, path, schema, spark.range(1).select(F.lit(chat_id).cast("bigint").alias("chat_id")))


def save_chats(spark: SparkSession, path: str, save: int, incoming: DataFrame, incoming_messages: DataFrame, now: Column) -> None:
    """Add or change the ``incoming`` chats (see ``upsert_chats``): only their stored rows are joined, only they are written."""
    known = current(spark, path, CHATS, incoming.select("chat_id"))
    append_save(upsert_chats(known, incoming, incoming_messages, now), path, save)


def compact(spark: SparkSession, path: str, new_path: str, schema: str) -> None:
    """A new store of one save with what readers of the old one see."""
    append_save(current(spark, path, schema), new_path, 0)


def compact_store(spark: SparkSession, path: str, schema: str, many: int = manifest.MANY) -> int:
    """Merge the folders of buckets that have ``many`` or more; readers see the same before, meanwhile and after. Returns the buckets merged."""
    return manifest.compact(spark, path, f"{schema}, removed boolean", _latest, many)
