"""Stores of chat rows that grow by folders: data first, then an entry in an append-only manifest that makes it visible.

* ``data/folder=…/bucket=…``: rows by a hash of ``chat_id``, so that all rows of a chat are in one bucket of every folder.
* ``manifest``: a row per folder and bucket with its least and greatest chat. A folder without entries does not exist for readers,
  so a write that is lost half-way leaves the store as it was. Of several attempts at one number the last one counts.
* Compaction writes a bucket anew and names the folders it stands for; from that entry on they are no longer read. Rows keep their ``number``
  and ``attempt``, so what readers resolve stays the same.

Readers who want some chats read the buckets of these chats in the folders whose range they lie in.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 32  # rows are sorted by chat inside one, so row groups are skipped by their ranges
ENTRIES = "number bigint, attempt bigint, folder string, bucket int, least bigint, most bigint, n_rows bigint, covers array<string>"
MANY = 8  # folders of a bucket from which on it is worth compacting
NO_BUCKET = -1  # of an attempt that brought no rows


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; an empty one when nothing readable is there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def bucket_of(chat_id: Column) -> Column:
    return F.pmod(F.xxhash64(chat_id), F.lit(BUCKETS)).cast("int")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's entries that count: a row per folder and bucket."""
    known = read_or_empty(spark, f"{path}/manifest", ENTRIES)
    latest = F.max("attempt").over(Window.partitionBy("number"))
    saved = known.where("covers IS NULL").withColumn("latest", latest).where("attempt = latest").drop("latest")
    compacted = known.where("covers IS NOT NULL")
    covered = compacted.select("bucket", F.explode("covers").alias("folder")).distinct()
    return saved.unionByName(compacted).where(F.col("bucket") != NO_BUCKET).join(covered, ["bucket", "folder"], "left_anti")


def _publish(spark: SparkSession, path: str, rows: DataFrame, number: int, attempt: int, covers: DataFrame | None = None) -> None:
    """Write ``rows`` to a folder of their own, then their entries. ``covers`` has ``bucket`` and ``covers`` for a compaction."""
    folder = uuid.uuid4().hex
    target = f"{path}/data/folder={folder}"
    placed = rows.withColumn("bucket", bucket_of(F.col("chat_id"))).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", "chat_id").write.partitionBy("bucket").parquet(target)
    stored = spark.read.schema(f"{_ddl(rows)}, bucket int").parquet(target)
    found = stored.groupBy("bucket").agg(F.min("chat_id").alias("least"), F.max("chat_id").alias("most"), F.count("*").alias("n_rows"))
    if covers is None:
        nothing = spark.range(1).select(F.lit(NO_BUCKET).alias("bucket"), *[F.lit(None).cast("bigint").alias(c) for c in ("least", "most")], F.lit(0).cast("bigint").alias("n_rows"))
        found = found.union(nothing).withColumn("covers", F.lit(None).cast("array<string>"))
    else:
        found = covers.join(found, "bucket", "left").select("bucket", "least", "most", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "covers")
    made = found.withColumns({"number": F.lit(number).cast("bigint"), "attempt": F.lit(attempt).cast("bigint"), "folder": F.lit(folder)})
    made.select(*[f.split()[0] for f in ENTRIES.split(", ")]).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def append(rows: DataFrame, path: str, number: int) -> None:
    """Store ``rows`` (with ``chat_id``) under ``number``; a repeated number replaces what it had stored."""
    attempt = time.time_ns()
    marked = rows.withColumns({"number": F.lit(number).cast("bigint"), "attempt": F.lit(attempt).cast("bigint")})
    _publish(rows.sparkSession, path, marked, number, attempt)


def read(spark: SparkSession, path: str, schema: str, chats: DataFrame | None = None) -> DataFrame:
    """The stored rows with ``number`` and ``attempt``, as yet unresolved.

    With ``chats`` (a column ``chat_id``) only the folders and buckets that may hold one of these chats are read; other
    chats of these buckets come along.
    """
    return _rows(spark, path, schema, entries(spark, path), chats)


def _rows(spark: SparkSession, path: str, schema: str, found: DataFrame, chats: DataFrame | None) -> DataFrame:
    full = f"{schema}, number bigint, attempt bigint"
    if chats is not None:
        wanted = chats.where("chat_id IS NOT NULL").groupBy(bucket_of(F.col("chat_id")).alias("bucket")).agg(F.min("chat_id").alias("from"), F.max("chat_id").alias("to"))
        found = found.join(F.broadcast(wanted), "bucket").where("least <= to AND most >= from")  # a row per bucket at most
        places = sorted({f"{path}/data/folder={r['folder']}/bucket={r['bucket']}" for r in found.select("folder", "bucket").collect()})
        if not places:
            return spark.createDataFrame([], full)
        return spark.read.schema(f"{full}, folder string, bucket int").option("basePath", f"{path}/data").parquet(*places).drop("folder", "bucket")
    stored = read_or_empty(spark, f"{path}/data", f"{full}, folder string, bucket int")
    return stored.join(found.select("folder", "bucket"), ["folder", "bucket"], "left_semi").drop("folder", "bucket")


def compact(spark: SparkSession, path: str, schema: str, resolve, many: int = MANY) -> int:
    """Rewrite the buckets that lie in ``many`` folders or more; returns how many.

    ``resolve`` turns the rows of whole buckets (with ``number`` and ``attempt``) into fewer that readers resolve to the same. Entries that
    arrive meanwhile stay as they are, because a compaction replaces only the folders it has read.
    """
    known = entries(spark, path).persist()
    try:
        full = known.groupBy("bucket").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("folder")).alias("covers"), F.max("number").alias("number")).where(F.col("n") >= many)
        chosen = full.collect()  # a row per bucket at most, with the folders of that bucket
        if not chosen:
            return 0
        pairs = spark.createDataFrame([(r["bucket"], r["covers"]) for r in chosen], "bucket int, covers array<string>")
        places = [f"{path}/data/folder={f}/bucket={r['bucket']}" for r in chosen for f in r["covers"]]
        complete = f"{schema}, number bigint, attempt bigint"
        rows = spark.read.schema(f"{complete}, folder string, bucket int").option("basePath", f"{path}/data").parquet(*places).drop("folder", "bucket")
        _publish(spark, path, resolve(rows), max(r["number"] for r in chosen), time.time_ns(), pairs)
        return len(chosen)
    finally:
        known.unpersist()
