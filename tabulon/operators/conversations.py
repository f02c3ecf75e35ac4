"""Conversation tables.

A conversation may grow without bound, so a chat is not one nested record here but two tables:

* chats: ``chat_id, title, source_name, created_at, updated_at, autosaved``
* messages: ``chat_id, turn, role, content, figure_b64`` – the ordered list is the order of ``turn``

Only previews and contexts put several messages into one value, and both are bounded: they take
a limited number of rows per chat (limited inside every task before the shuffle) and a limited
number of characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.text import chat_title, decode_figure, encode_figure, filled, message_line, strip, truncate_text

# Limits and readable roles.
PREVIEW_CHARS = 900
CONTEXT_MESSAGES = 8
CONTEXT_CHARS = 3000
READABLE_ROLES = ("user", "assistant")


def messages_from(df: DataFrame, chat_id: str, turn: str, role: str, content: str, figure: str | None = None) -> DataFrame:
    """Any message table in the column names used here; ``figure`` is a binary column."""
    encoded = encode_figure(F.col(figure)) if figure else F.lit(None).cast("string")
    return df.select(
        F.col(chat_id).alias("chat_id"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.col(content).alias("content"),
        encoded.alias("figure_b64"),
    )


def clean_for_storage(messages: DataFrame) -> DataFrame:
    """Trim role and content, drop messages that lack either; every role is kept."""
    trimmed = messages.withColumns({"role": strip(F.col("role")), "content": strip(F.col("content"))})
    return trimmed.where("role <> '' AND content <> ''")


def clean_loaded(messages: DataFrame) -> DataFrame:
    """Messages a reader may see: user and assistant, not blank, figures decoded."""
    return (
        clean_for_storage(messages)
        .where(F.col("role").isin(*READABLE_ROLES))
        .withColumn("figure", decode_figure(F.col("figure_b64")))
        .drop("figure_b64")
    )


def _first_contents(messages: DataFrame) -> DataFrame:
    """Start of each chat's first message; combined per chat before the shuffle."""
    start = messages.select("chat_id", "turn", F.left("content", F.lit(200)).alias("start"))
    return start.groupBy("chat_id").agg(F.min_by("start", "turn").alias("start"), F.count(F.lit(1)).alias("messages"))


def chat_records(messages: DataFrame, source_name: Column, now: Column, autosaved: bool = False) -> DataFrame:
    """New chats for cleaned messages; chats without any message do not appear."""
    return _first_contents(messages).select(
        "chat_id",
        chat_title(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("start")).alias("title"),
        source_name.alias("source_name"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit(autosaved).alias("autosaved"),
        "messages",
    )


PARTS = 256  # of a chat, each of which is ranked by itself first


def _leading(messages: DataFrame, order: Column, k: int) -> DataFrame:
    """The first ``k`` messages of every chat in ``order``, with their ``rank``.

    Spark limits each task's rows per chat before the shuffle; chats are ranked in parts first and the parts'
    winners ranked again, so a chat of any length is no single task's work.
    """
    part = F.pmod(F.xxhash64("turn"), F.lit(PARTS))
    within = F.row_number().over(Window.partitionBy("chat_id", "part").orderBy(order))
    messages = messages.withColumn("part", part).withColumn("rank", within).where(F.col("rank") <= k).drop("part", "rank")
    rank = F.row_number().over(Window.partitionBy("chat_id").orderBy(order))
    return messages.withColumn("rank", rank).where(F.col("rank") <= k)


def conversation_preview(messages: DataFrame, max_chars: int = PREVIEW_CHARS) -> DataFrame:
    """``(chat_id, preview)``: lines ``role: content`` joined by line breaks and cut.

    A line and its break take at least two characters, so ``max_chars // 2 + 1`` lines always
    reach the cut and later ones cannot show.
    """
    line = message_line(F.col("role"), F.col("content"), F.coalesce(F.col("figure_b64"), F.lit("")) != "")
    lines = messages.where("content <> ''").select("chat_id", "turn", F.left(line, F.lit(max_chars + 1)).alias("line"))
    first = _leading(lines, F.asc("turn"), max_chars // 2 + 1)
    listed = first.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return listed.select("chat_id", truncate_text(text, max_chars).alias("preview"))


def recent_context(messages: DataFrame, max_messages: int = CONTEXT_MESSAGES, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``(chat_id, context)``: of the last ``max_messages`` messages those that are not blank, as
    ``role: content`` lines, cut to the last ``max_chars`` characters.

    A message only ever shows its last ``max_chars`` characters, so no more of it is shuffled.
    """
    tail = messages.select(
        "chat_id", "turn", strip(F.col("role")).alias("role"), F.right(strip(F.col("content")), F.lit(max_chars)).alias("content")
    )
    last = _leading(tail, F.desc("turn"), max_messages)
    spoken = F.when((F.col("role") != "") & (F.col("content") != ""), F.struct(-F.col("rank"), F.concat_ws(": ", "role", "content")))
    listed = last.groupBy("chat_id").agg(F.array_sort(F.collect_list(spoken)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["col2"]), "\n")
    return listed.select("chat_id", F.right(text, F.lit(max_chars)).alias("context"))


def upsert_chats(chats: DataFrame, incoming: DataFrame, incoming_messages: DataFrame, now: Column) -> DataFrame:
    """The chat table after saving ``incoming`` (``chat_id, title, source_name, autosaved``).

    A known chat keeps ``created_at`` and, without a new title, its title; ``autosaved`` stays
    true once set; incoming chats without messages change nothing.
    """
    saved = incoming.join(_first_contents(clean_for_storage(incoming_messages)), "chat_id")
    old, new = chats.alias("old"), saved.alias("new")
    joined = old.join(new, F.col("old.chat_id") == F.col("new.chat_id"), "full_outer")
    is_new = F.col("new.chat_id").isNotNull()
    title = chat_title(F.col("new.title"), F.col("old.title"), F.col("new.start"))
    return joined.select(
        F.coalesce("new.chat_id", "old.chat_id").alias("chat_id"),
        F.when(is_new, title).otherwise(F.col("old.title")).alias("title"),
        F.when(is_new, F.col("new.source_name")).otherwise(F.col("old.source_name")).alias("source_name"),
        F.coalesce("old.created_at", now).alias("created_at"),
        F.when(is_new, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
        (F.coalesce("new.autosaved", F.lit(False)) | F.coalesce("old.autosaved", F.lit(False))).alias("autosaved"),
    )


def upsert_messages(messages: DataFrame, incoming_messages: DataFrame) -> DataFrame:
    """Stored messages with those of every saved chat replaced."""
    fresh = clean_for_storage(incoming_messages)
    kept = messages.join(fresh.select("chat_id").distinct(), "chat_id", "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def list_chats(chats: DataFrame) -> DataFrame:
    """Most recently saved first."""
    return chats.orderBy(F.desc("updated_at"), "chat_id")


def load_chat(messages: DataFrame, chat_id) -> DataFrame:
    """The readable messages of one chat in order; an error when there are none."""
    found = clean_loaded(messages.where(F.col("chat_id") == chat_id))
    if found.isEmpty():
        raise ValueError(f"no chat {chat_id!r} with readable messages")
    return found.orderBy("turn")


def load_chats(messages: DataFrame, chat_ids: DataFrame) -> DataFrame:
    """Readable messages of all chats listed in ``chat_ids``."""
    return clean_loaded(messages.join(chat_ids.select("chat_id").distinct(), "chat_id", "left_semi"))


def delete_chats(table: DataFrame, chat_ids: DataFrame) -> DataFrame:
    """``table`` (chats or messages) without the listed chats."""
    return table.join(chat_ids.select("chat_id").distinct(), "chat_id", "left_anti")


def source_mismatch(saved: Column, active: Column) -> Column:
    """Whether a saved chat names another source than the active one."""
    return filled(saved).isNotNull() & ~saved.eqNullSafe(active)


def source_changed(previous: Column, current: Column) -> Column:
    return ~previous.eqNullSafe(current)
