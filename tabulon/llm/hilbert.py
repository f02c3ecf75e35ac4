"""Sharding along a Hilbert curve through several metadata columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.ordering import replaced, running
from tabulon.session import scratch_path

BITS = 10
SHARDS = 16


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points (one row each) with ``bits`` bits per axis.

    Skilling's transposition: undo the rotations from the highest bit down, Gray-code, interleave.
    """
    x = axes.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1) << np.uint64(bits - 1)
    one = np.uint64(1)
    while q > one:
        low = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > one:
        flip ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << one) | ((x[i] >> np.uint64(bit)) & one)
    return index.astype(np.int64)


def text_cell(column: Column, bits: int) -> Column:
    """The cell of a text: its value's hash, so equal values share a cell and values spread evenly; null: cell 0."""
    return F.when(column.isNull(), 0).otherwise(F.pmod(F.xxhash64(column), F.lit((1 << bits) - 1)) + 1).cast("long")


def log_cell(column: Column, bits: int) -> Column:
    """The cell of a number of 0 or more: 32 cells for each doubling; negative or null: cell 0."""
    cell = F.floor(F.log2(F.greatest(column, F.lit(0)) + 1) * 32)
    return F.least(F.coalesce(cell, F.lit(0)), F.lit((1 << bits) - 1)).cast("long")


def hilbert_shards(df: DataFrame, cells: Sequence[Column], ties: Sequence[Column], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Cut the table into ``shards`` runs of the Hilbert curve through ``cells``; counts differ by one at most.

    Returns all columns of ``df`` plus ``curve`` (the curve index), ``shard`` (0 up) and ``slot`` (the place
    in the shard, gapless from 0); its own columns of these names are replaced. Rows of one cell
    are ordered by ``ties``; rows equal in these too are interchangeable. With fewer rows than shards
    the last shards stay empty; an empty table gives no rows.
    """
    if len(cells) * bits > 62:
        raise ValueError("the curve index has 62 bits at most")

    @F.pandas_udf("long")
    def curve(*axes: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack([a.to_numpy() for a in axes], axis=1), bits))

    order = [f"__order{i}" for i in range(len(ties))]
    keyed = replaced(df, {"curve": curve(*cells), "shard": F.lit(0), "slot": F.lit(0).cast("long")})
    keyed = keyed.drop("shard", "slot").withColumns({"__one": F.lit(1).cast("long"), **dict(zip(order, ties, strict=True))})
    ranked = running(keyed, ["curve", *order], "__one", "__rank", label="hilbert")
    total = ranked.count()
    short, extra = divmod(total, shards)
    rank = F.col("__rank")
    long_rows = extra * (short + 1)  # rows of the shards that have one more
    in_long = rank < long_rows
    later = rank - long_rows
    per = max(short, 1)
    return ranked.withColumns(
        {
            "shard": F.when(in_long, F.floor(rank / (short + 1))).otherwise(F.floor(later / per) + extra).cast("int"),
            "slot": F.when(in_long, rank % (short + 1)).otherwise(later % per),
        }
    ).drop("__rank", "__one", *order)


def document_shards(docs: DataFrame, shards: int = SHARDS, keep: Sequence[str] | None = None) -> DataFrame:
    """``hilbert_shards`` of documents over source, language and size, plus ``size`` and ``text_crc32``.

    ``size`` is the number of UTF-8 bytes of the text plus 1, a null text has none; its CRC-32 is 0, as of an empty one.
    ``keep`` names the columns to carry along (all of them if None); own columns of the new names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("size", "text_crc32")]
    sized = docs.select(
        *(F.col(f"`{c}`") for c in carried),
        F.octet_length(text).cast("long").alias("__bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "lang")),
    ).withColumn("size", F.col("__bytes") + 1)
    cells = [text_cell(F.col("__source"), BITS), text_cell(F.col("__lang"), BITS), log_cell(F.col("size"), BITS)]
    sharded = hilbert_shards(sized, cells, [F.col("__doc_id"), F.col("text_crc32"), F.col("size")], shards)
    return sharded.drop("__bytes", "__doc_id", "__source", "__lang")


def write_shards(sharded: DataFrame, path: str | None = None) -> str:
    """Write sharded rows as Parquet, one folder per shard, sorted by slot; returns the folder.

    A shard is split over several tasks, by runs of slots, so a large one isn't one task's work.
    """
    path = path or scratch_path(sharded.sparkSession, "shards")
    tasked = sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
    tasked.write.partitionBy("shard").parquet(path)
    return path
