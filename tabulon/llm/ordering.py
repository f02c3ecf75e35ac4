"""Running sums over a whole ordered table, without a window that one task would have to hold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.session import staged

SEED = 7
BROADCAST_ROWS = 100_000  # larger tables are joined by a shuffle


def running(df: DataFrame, order: Sequence[str], amount: str, before: str, by: str | None = None, label: str = "running") -> DataFrame:
    """``df`` plus the long ``before``: the sum of ``amount`` over the rows that precede a row of the same ``by``.

    Rows are ordered by ``order`` (nulls first); rows equal in all of it follow in any order, which
    changes nothing but which of them gets which sum. ``amount`` must not be null or negative.
    The table is range partitioned once and written; each task sums within itself, and the
    sums of the tasks (one row per task and ``by``) are added in front. A ``by`` that holds
    most of the rows spreads over many tasks.
    """
    spark = df.sparkSession
    keys = ([by] if by else []) + list(order)
    tie, task, inside = (f"__{label}_{x}" for x in ("tie", "task", "inside"))
    sorted_rows = (
        df.withColumn(tie, F.rand(SEED))
        .repartitionByRange(*(F.col(k) for k in keys), F.col(tie))
        .sortWithinPartitions(*keys, tie)
        .drop(tie)
        .withColumn(task, F.spark_partition_id())
    )
    schema = T.StructType([*sorted_rows.schema.fields, T.StructField(inside, T.LongType())])

    def sums(batches):
        last, total = None, 0
        for batch in batches:
            amounts = batch.column(amount).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(amounts):
                continue
            prefix = np.cumsum(amounts) - amounts
            if by:
                codes = batch.column(by).dictionary_encode(null_encoding="encode")
                names, index = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
                run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(index)]))
                shift = -prefix[starts]
                if last is not None and names[index[0]] == last[0]:
                    shift[0] += total
                value = prefix + shift[run]
                last = (names[index[-1]],)
            else:
                value = prefix + total
            total = int(value[-1] + amounts[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.int64())], [*batch.schema.names, inside])

    rows = staged(sorted_rows.mapInArrow(sums, schema), label)
    in_task = rows.groupBy(task, *([by] if by else [])).agg(F.sum(amount).alias("__sum"))
    earlier = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    if by:
        earlier = Window.partitionBy(by).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task (and value of ``by`` in it): as many as there are partitions.
    offsets = in_task.select(
        F.col(task).alias("__t"),
        *([F.col(by).alias("__b")] if by else []),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"),
    )
    if not by:
        offsets = F.broadcast(offsets)
    else:
        offsets = staged(offsets, label)
        if offsets.count() <= BROADCAST_ROWS:
            offsets = F.broadcast(offsets)
    match = F.col(task) == F.col("__t")
    if by:
        match = match & F.col(by).eqNullSafe(F.col("__b"))
    joined = rows.join(offsets, match)
    return joined.withColumn(before, F.col("__offset") + F.col(inside)).drop("__t", "__b", "__offset", task, inside)


def unique_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one when the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``; its own columns of these names go."""
    names = {c.lower() for c in columns}
    return df.select(*(df[f"`{c}`"] for c in df.columns if c.lower() not in names), *(e.alias(c) for c, e in columns.items()))
