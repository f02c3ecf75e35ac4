"""Correlations of many columns by products of whole matrices, each pair over the rows that have both values.

With Z the shifted values (0 where missing) and M the marks of those present, five products tell everything about all pairs: M'M counts the
rows, Z'M and (ZZ)'M sum values and squares of one column where the other one is present, Z'Z the products. The fifth marks infinities,
whose pairs have no correlation. A task adds up its batches and returns one row per pair, so plans and code do not grow with the columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import present

ROWS = 4096  # multiplied at once
SHIFT_ROWS = 1000  # whose mean is taken off each column; any shift gives the same result but for rounding
FLAT = 1e-13  # of the mean square: less variance is rounding


def pairwise_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """``i``, ``j`` (i <= j: places in ``columns``) and over the rows with both values ``n``, ``si``, ``sj``, ``qi``, ``qj``, ``p`` (of shifted values) and ``odd`` (rows with an infinity)."""
    names = [f"v_{i}" for i in range(len(columns))]
    values = df.select(*[present(df, c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    first = values.limit(SHIFT_ROWS).toArrow()
    shift = np.zeros(len(names))
    for i, n in enumerate(names):
        known = first.column(n).drop_null().to_numpy()
        known = known[np.isfinite(known)]
        shift[i] = known.mean() if len(known) and np.isfinite(known.mean()) else 0.0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(names)
        total = np.zeros((5, d, d))
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                part = whole.slice(low, ROWS)
                z = np.column_stack([part.column(n).to_numpy(zero_copy_only=False) for n in names]) - shift
                missing = np.column_stack([np.asarray(part.column(n).is_null()) for n in names])
                odd = ~missing & ~np.isfinite(z)
                mark = (~missing).astype(float)
                z[missing | odd] = 0.0
                total += (mark.T @ mark, z.T @ mark, (z * z).T @ mark, z.T @ z, odd.T.astype(float) @ mark)
        n, s, q, p, odd = total
        for i in range(d):
            if n[i, i]:
                j = np.arange(i, d)
                columns = [n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j], odd[i, j] + odd[j, i]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i)), pa.array(j), *map(pa.array, columns)], ["i", "j", *SUMS])

    each = values.mapInArrow(sums, f"i long, j long, {', '.join(f'{s} double' for s in SUMS)}")
    return each.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


SUMS = ["n", "si", "sj", "qi", "qj", "p", "odd"]


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_x, column_y, correlation)`` for all pairs in one scan.

    Null without rows in common or with one, NaN where an infinity takes part or a column has no variance.
    """
    x, y = F.col("qi") - F.col("si") * F.col("si") / F.col("n"), F.col("qj") - F.col("sj") * F.col("sj") / F.col("n")
    flat = (x <= F.lit(FLAT) * F.col("qi")) | (y <= F.lit(FLAT) * F.col("qj"))
    nan = F.lit(float("nan"))
    r = F.when(F.col("n") < 2, None).when((F.col("odd") > 0) | flat, nan).when(F.col("i") == F.col("j"), F.lit(1.0))
    r = r.otherwise((F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / F.sqrt(x) / F.sqrt(y))
    found = pairwise_sums(df, columns).select("i", "j", r.alias("correlation"))
    both = found.union(found.where("i < j").select("j", "i", "correlation"))
    names = F.array(*[F.lit(c) for c in columns])
    places = df.sparkSession.range(len(columns)).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("b"))
    every = places.select("a", "b", F.get(names, F.col("a").cast("int")).alias("column_x"), F.get(names, "b").alias("column_y"))
    return every.join(both, (F.col("a") == F.col("i")) & (F.col("b") == F.col("j")), "left").select("column_x", "column_y", "correlation")
