"""Computations a user asks for on the loaded table: filter, group, pivot, sort, correlation,
regression, histogram, scatter data, user functions.

Missing grouping keys form no group, and missing values take part in no statistic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations_with_replacement
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import col, numeric_columns, present, require_columns
from tabulon.operators.gram import correlations
from tabulon.operators.quantiles import fits_direct, percentile_expr, percentile_values, percentiles, sketches
from tabulon.session import staged

GROUP_TASKS = 4  # per core, where a user function takes whole groups


def filter_rows(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(F.expr(predicate))


def sort_rows(df: DataFrame, order: list[tuple[str, str]], limit: int | None = None) -> DataFrame:
    """``order`` lists ``(column, "asc" | "desc")``; missing values come last either way."""
    keys = [
        present(df, n).desc_nulls_last() if direction == "desc" else present(df, n).asc_nulls_last()
        for n, direction in order
    ]
    ordered = df.orderBy(*keys)
    return ordered if limit is None else ordered.limit(limit)


def preview(df: DataFrame, rows: int = 10, order: list[tuple[str, str]] | None = None) -> DataFrame:
    """The first rows for display; which ones is only defined with an ``order``."""
    return sort_rows(df, order, rows) if order else df.limit(rows)


_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "sum": F.sum,
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "nunique": F.count_distinct,
}


def _aggregate(df: DataFrame, name: str, function: str) -> Column:
    if function == "size":
        return F.count(F.lit(1)).alias(name or "size")
    return _AGGREGATES[function](present(df, name)).alias(f"{function}_{name}")


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that have all grouping keys."""
    return df.where(reduce(Column.__and__, [present(df, k).isNotNull() for k in keys])) if keys else df


def group_aggregate(
    df: DataFrame, keys: list[str], aggregates: dict[str, list[str]], direct_rows: int | None = None
) -> DataFrame:
    """``aggregates`` maps a column to function names (``count sum mean median std min max
    nunique``); result columns are ``function_column``. ``{"*": ["size"]}`` counts rows.

    Medians are exact: in the same aggregate while the row count is known to be small, through
    the narrowed percentiles otherwise.
    """
    require_columns(df, [*keys, *[c for c in aggregates if c != "*"]])
    df = with_keys(df, keys)
    medians = [c for c, functions in aggregates.items() if "median" in functions]
    direct = not medians or fits_direct(df, direct_rows)
    columns = []
    order = [col(k) for k in keys]
    for name, functions in aggregates.items():
        for function in functions:
            order.append(col("size" if name == "*" else f"{function}_{name}"))
            if function == "median":
                if direct:
                    middle = percentile_expr(present(df, name).cast("double"), [0.5])
                    columns.append(F.get(middle, F.lit(0)).alias(f"median_{name}"))
            else:
                columns.append(_aggregate(df, "" if name == "*" else name, function))
    grouped = df.groupBy(*[col(k) for k in keys])
    if direct:
        return grouped.agg(*(columns or [F.count(F.lit(1)).alias("size")]))
    if not keys:
        middle = percentile_values(df, medians, 0.5, direct_rows=-1)
        return grouped.agg(*(columns or [F.count(F.lit(1)).alias("size")])).withColumns({f"median_{m}": F.lit(middle.get(m)).cast("double") for m in medians}).select(*order)
    # The sketches that the medians start from come out of the same scan.
    grouped = staged(grouped.agg(*columns, *sketches(df, medians, [0.5])), "grouped")
    middle = percentiles(df, medians, [0.5], tuple(keys), direct_rows=-1, sketch=grouped)
    wide = middle.groupBy(*[col(k) for k in keys]).pivot("column", medians).agg(F.first(F.get("q", F.lit(0))))
    wide = wide.withColumnsRenamed({m: f"median_{m}" for m in medians})
    return grouped.join(wide, keys, "left").select(*order)


def summary(df: DataFrame, column: str, direct_rows: int | None = None) -> DataFrame:
    """Mean, median and sample deviation of one column."""
    return group_aggregate(df, [], {column: ["mean", "median", "std"]}, direct_rows)


def pivot_table(
    df: DataFrame, index: list[str], column: str, value: str, function: str = "mean", categories: list | None = None
) -> DataFrame:
    """One row per ``index``, one result column per category. Naming the categories saves a job."""
    require_columns(df, [*index, column, value])
    df = with_keys(df, [*index, column])
    aggregate = _AGGREGATES[function](present(df, value))
    return df.groupBy(*[col(i) for i in index]).pivot(column, categories).agg(aggregate)


WIDE = 16  # columns up to which all pairs fit into one generated aggregate


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_x, column_y, correlation)`` for all pairs from one scan; each pair uses the
    rows in which both values are there. More than ``WIDE`` columns go through matrix products (``gram``)."""
    names = numeric_columns(df) if columns is None else columns
    require_columns(df, names, numeric=True)
    if len(names) > WIDE:
        return correlations(df, names)
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    values = [present(df, n).cast("double") for n in names]
    wide = df.agg(*[F.corr(values[i], values[j]).alias(f"r_{i}_{j}") for i, j in pairs])
    entries = [
        F.struct(
            F.lit(names[i]).alias("column_x"),
            F.lit(names[j]).alias("column_y"),
            F.col(f"r_{min(i, j)}_{max(i, j)}").alias("correlation"),
        )
        for i in range(len(names))
        for j in range(len(names))
    ]
    return wide.select(F.inline(F.array(*entries)))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(present(df, x).cast("double"), present(df, y).cast("double")).alias("correlation"))


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of ``y`` on ``x``: slope, intercept, r2 and the rows used."""
    require_columns(df, [x, y], numeric=True)
    xs, ys = present(df, x).cast("double"), present(df, y).cast("double")
    return df.agg(
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_r2(ys, xs).alias("r2"),
        F.regr_count(ys, xs).alias("n"),
    )


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``(bin, lower, upper, n)`` over equal-width bins; the last bin holds the maximum, empty
    bins are kept. Two column-pruned scans; one row per bin and task is shuffled."""
    require_columns(df, [column], numeric=True)
    value = present(df, column).cast("double")
    edges = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    low, high = edges["low"], edges["high"]
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.floor((value - F.lit(low)) / F.lit(width)).cast("int") + 1, F.lit(bins))
    counted = df.where(value.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + (F.col("id") - 1) * F.lit(width)).alias("lower"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("upper"),
    )
    return frame.join(counted, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def scatter_points(df: DataFrame, x: str, y: str, share: float | None = None, key: list[str] | None = None) -> DataFrame:
    """The ``(x, y)`` pairs without missing values; for display, ``share`` keeps that part of the
    rows, chosen by a hash of ``key`` (the same rows on every run)."""
    require_columns(df, [x, y], numeric=True)
    if share is not None and not key:
        raise ValueError("a display sample needs the key columns that identify a row")
    if share is not None:
        df = df.where(F.pmod(F.xxhash64(*[col(k) for k in key]), F.lit(1_000_000)) < int(share * 1_000_000))
    pairs = df.select(present(df, x).cast("double").alias("x"), present(df, y).cast("double").alias("y"))
    return pairs.where("x IS NOT NULL AND y IS NOT NULL")


def apply_to_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A row-wise user function over Arrow batches; it must not depend on batch borders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def apply_by_group(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, max_rows: int | None = None) -> DataFrame:
    """A user function that needs a whole group in memory.

    Groups without a bound belong in :func:`group_aggregate`, :func:`combine_by_group` or :func:`stream_by_group`; with ``max_rows`` the
    largest group is counted first and must stay within it. The shuffle makes ``GROUP_TASKS`` tasks per core whatever the
    bytes of the rows: the function's time is what they share.
    """
    df = with_keys(df, keys)
    if max_rows is not None:
        largest = df.groupBy(*[col(k) for k in keys]).count().agg(F.max("count").alias("n")).first()["n"] or 0
        if largest > max_rows:
            raise ValueError(f"a group holds {largest} rows (limit {max_rows}); use combine_by_group")
    tasks = GROUP_TASKS * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *[col(k) for k in keys]).groupBy(*[col(k) for k in keys]).applyInPandas(function, schema)


def stream_by_group(
    df: DataFrame, keys: list[str], function: Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, order: list[str] | None = None
) -> DataFrame:
    """A user function that sees each group as a stream of frames, sorted by ``order``, and yields frames; no group is held whole.

    ``function`` gets the group's key and its frames; what it leaves unread is skipped. A group is one task's work and
    is read once; it needs no more memory than a frame and what ``function`` keeps. Rows with a missing key belong to no group.
    """
    df = with_keys(df, keys)
    together = df.repartition(*[col(k) for k in keys]).sortWithinPartitions(*[col(k) for k in [*keys, *(order or [])]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple[tuple, pd.DataFrame]] = []  # the next part, once it is known

        def parts() -> Iterator[tuple[tuple, pd.DataFrame]]:
            for batch in batches:
                if len(batch):
                    change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
                    change[0] = True
                    edges = [*change.nonzero()[0].tolist(), len(batch)]
                    for low, high in zip(edges, edges[1:]):
                        yield tuple(batch[keys].iloc[low]), batch.iloc[low:high].reset_index(drop=True)

        source = parts()

        def of(key: tuple) -> Iterator[pd.DataFrame]:
            while waiting or (part := next(source, None)) is not None:
                if waiting:
                    part = waiting.pop()
                if part[0] != key:
                    waiting.append(part)
                    return
                yield part[1]

        while waiting or (part := next(source, None)) is not None:
            if not waiting:
                waiting.append(part)
            key = waiting[0][0]
            frames = of(key)
            yield from function(key, frames)
            for _ in frames:
                pass

    return together.mapInPandas(run, schema)


def combine_by_group(
    df: DataFrame,
    keys: list[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    final: list[Column],
) -> DataFrame:
    """A user function in two steps for groups of any size.

    ``partial`` reduces each Arrow batch to a few rows per key (schema ``schema``, keys
    included) and ``final`` are the Spark aggregates that merge them, so a hot group is reduced
    where its rows are read.
    """
    reduced = apply_to_batches(with_keys(df, keys), partial, schema)
    return reduced.groupBy(*[col(k) for k in keys]).agg(*final)


_STEPS: dict[str, Callable[[DataFrame, Any], DataFrame]] = {
    "filter": filter_rows,
    "select": lambda df, names: df.select(*[col(n) for n in names]),
    "group": lambda df, s: group_aggregate(df, s["keys"], s["aggregates"]),
    "pivot": lambda df, s: pivot_table(df, **s),
    "sort": lambda df, s: sort_rows(df, **s),
    "correlation": lambda df, names: correlation_matrix(df, names),
    "regression": lambda df, s: regression_line(df, **s),
    "histogram": lambda df, s: histogram(df, **s),
    "scatter": lambda df, s: scatter_points(df, **s),
    "limit": lambda df, n: df.limit(n),
}


def analyze(df: DataFrame, steps: list[tuple[str, Any]]) -> DataFrame:
    """Run named steps in order, e.g. ``[("filter", "x > 1"), ("group", {...}), ("sort", {...})]``.

    Each step only adds to the DataFrame plan; Catalyst sees the whole request.
    """
    for name, argument in steps:
        if name not in _STEPS:
            raise ValueError(f"unknown step {name!r}; known: {sorted(_STEPS)}")
        df = _STEPS[name](df, argument)
    return df
