"""Feature preparation: clean, impute the exact median, standardise. All native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import col, finite, finite_columns, numeric_columns, require_columns
from tabulon.operators.quantiles import percentile_values

DEFAULT_FEATURES = 3


def default_features(df: DataFrame) -> list[str]:
    return numeric_columns(df)[:DEFAULT_FEATURES]


def drop_empty_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop columns that hold no value; rows stay. One counting pass."""
    names = df.columns if columns is None else columns
    filled = df.agg(*[F.count(col(n)).alias(f"n_{i}") for i, n in enumerate(names)]).first()
    empty = [n for i, n in enumerate(names) if filled[i] == 0]
    return df.drop(*empty)


def clean_features(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Chosen columns as doubles, NaN and infinities missing, empty columns left out.

    The other columns of ``df`` stay in place. Returns the frame and the usable columns.
    """
    require_columns(df, columns, numeric=True)
    cleaned = finite_columns(df, columns)
    kept = drop_empty_columns(cleaned.select(*[col(c) for c in columns])).columns
    if not kept:
        raise ValueError("no usable numeric data is left after cleaning")
    return cleaned, kept


def medians(df: DataFrame, columns: list[str], direct_rows: int | None = None) -> dict[str, float]:
    return percentile_values(df, columns, 0.5, direct_rows)


def impute_median(df: DataFrame, columns: list[str], direct_rows: int | None = None) -> DataFrame:
    middle = medians(df, columns, direct_rows)
    return df.withColumns({c: F.coalesce(col(c), F.lit(middle[c])) for c in columns if c in middle})


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(x - mean) / population deviation`` per column; a constant column becomes 0."""
    stats = df.agg(
        *[F.avg(col(c)).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(col(c)).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        mean, deviation = stats[f"m_{i}"], stats[f"s_{i}"]
        scaled[c] = (col(c) - F.lit(mean)) / F.lit(deviation) if deviation else F.when(col(c).isNotNull(), F.lit(0.0))
    return df.withColumns(scaled)


def prepared(df: DataFrame, columns: list[str], prefix: str = "f_") -> tuple[DataFrame, list[str], list[str]]:
    """Original rows plus standardised feature columns ``f_0 … f_n``.

    Returns the frame, the feature column names and the source columns they stand for.
    """
    require_columns(df, columns, numeric=True)
    features = [f"{prefix}{i}" for i in range(len(columns))]
    wide = df.withColumns({f: finite(df, c) for f, c in zip(features, columns)})
    kept = drop_empty_columns(wide.select(*features)).columns
    if not kept:
        raise ValueError("no usable numeric data is left after cleaning")
    sources = [c for f, c in zip(features, columns) if f in kept]
    wide = wide.drop(*[f for f in features if f not in kept])
    return standardize(impute_median(wide, kept), kept), kept, sources


def unpacked(df: DataFrame, array_column: str, size: int, prefix: str = "e_") -> tuple[DataFrame, list[str]]:
    """An array column of known length as plain double columns."""
    names = [f"{prefix}{i}" for i in range(size)]
    return df.withColumns({n: F.get(col(array_column), F.lit(i)).cast("double") for i, n in enumerate(names)}), names
