"""Autosave: a stream of message files kept as chats.

Each micro-batch writes its messages to a folder of their own and then makes it visible under the batch's number (see
``sources.manifest``); a repeat after a failure takes the place of what it repeats, so every message is stored once. A batch costs
what it brings, whatever the store holds. Readers resolve the store: per (chat, turn) the latest batch wins, and chats are
aggregates of their messages. :func:`compact` merges the folders of batches bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.functions.text import chat_title
from tabulon.operators.conversations import clean_for_storage
from tabulon.sources import manifest

STORED = "chat_id bigint, turn bigint, role string, content string, figure_b64 string, source_name string, saved_at timestamp, first_saved timestamp"


def autosave(
    messages: DataFrame,
    store: str,
    checkpoint: str,
    source_name: str,
    now: Callable[[], datetime] = datetime.now,
) -> StreamingQuery:
    """Start the stream; ``messages`` has ``chat_id, turn, role, content, figure_b64``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        at = F.lit(now()).cast("timestamp")
        stamped = clean_for_storage(batch).withColumns({"source_name": F.lit(source_name), "saved_at": at, "first_saved": at})
        manifest.append(stamped.select(*[f.split()[0] for f in STORED.split(", ")]), store, batch_id)

    return (
        messages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _turns(rows: DataFrame) -> DataFrame:
    """Each turn as last saved (twice in one batch: the larger text), with the times of its first and last save."""
    place = F.struct("number", "attempt", "content", "role")
    kept = F.struct("role", "content", "figure_b64", "source_name", "number", "attempt")
    latest = rows.groupBy("chat_id", "turn").agg(F.max_by(kept, place).alias("m"), F.max("saved_at").alias("saved_at"), F.min("first_saved").alias("first_saved"))
    return latest.select("chat_id", "turn", "m.role", "m.content", "m.figure_b64", "m.source_name", "saved_at", "first_saved", "m.number", "m.attempt")


def stored_messages(spark: SparkSession, store: str, chats: DataFrame | None = None) -> DataFrame:
    """The current messages; a turn that came twice counts once, as last saved (twice in one batch: the larger text).

    With ``chats`` (a column ``chat_id``) only these chats, from the buckets they lie in.
    """
    rows = manifest.read(spark, store, STORED, chats)
    if chats is not None:
        rows = rows.join(chats.select("chat_id").distinct(), "chat_id", "left_semi")
    return _turns(rows).select("chat_id", "turn", "role", "content", "figure_b64")


def stored_chats(spark: SparkSession, store: str) -> DataFrame:
    """One row per chat. The title is the start of its first turn, as last saved."""
    start = F.left("content", F.lit(200))
    none: Column = F.lit(None).cast("string")
    return _turns(manifest.read(spark, store, STORED)).groupBy("chat_id").agg(
        chat_title(none, none, F.min_by(start, "turn")).alias("title"),
        F.max_by("source_name", F.struct("number", "attempt", "turn")).alias("source_name"),
        F.min("first_saved").alias("created_at"),
        F.max("saved_at").alias("updated_at"),
        F.lit(True).alias("autosaved"),
    )


def compact(spark: SparkSession, store: str, many: int = manifest.MANY) -> int:
    """Merge the folders of buckets that lie in ``many`` or more, turn by turn; readers see the same. Returns the buckets merged."""
    return manifest.compact(spark, store, STORED, _turns, many)
