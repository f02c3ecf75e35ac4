"""Column selection by type and the rules for missing values.

``None``, ``NaN`` and ``NaT`` all count as missing in the tables this library stands in for;
Spark's ``NaN`` is a value, so every statistic goes through :func:`present` first. Infinity is
a value for profiling and turns into missing only in front of the models (:func:`finite`).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def col(name: str) -> Column:
    """A column by its exact name (dots and backticks are ordinary characters)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_categorical(data_type: T.DataType) -> bool:
    kinds = (T.StringType, T.VarcharType, T.CharType, T.BooleanType, T.BinaryType)
    return isinstance(data_type, kinds) or is_nested(data_type)


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StructType, T.ArrayType, T.MapType))


def family(data_type: T.DataType) -> str:
    if is_numeric(data_type):
        return "number"
    if is_categorical(data_type):
        return "category"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_categorical(f.dataType)]


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    value = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def finite(df: DataFrame, name: str) -> Column:
    """The column as double with NaN and both infinities turned into NULL."""
    value = col(name).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def as_text(df: DataFrame, name: str) -> Column:
    """The column as text; nested values as JSON, binary values as base64."""
    data_type = df.schema[name].dataType
    if is_nested(data_type):
        return F.to_json(col(name))
    if isinstance(data_type, T.BinaryType):
        return F.base64(col(name))
    return present(df, name).cast("string")


def normalize_missing(df: DataFrame) -> DataFrame:
    return df.select(*[present(df, n).alias(n) for n in df.columns])


def finite_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: finite(df, n) for n in names})


def require_columns(df: DataFrame, names: list[str], at_least: int = 1, numeric: bool = False) -> None:
    """Check a column choice against the schema; no job is started."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    if len(names) < at_least:
        raise ValueError(f"at least {at_least} column(s) are needed, got {len(names)}")
    if numeric:
        wrong = [n for n in names if not is_numeric(df.schema[n].dataType)]
        if wrong:
            raise ValueError(f"not numeric: {wrong}")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of driver-side rows as a local relation (no Python data source, no job)."""
    fields = T.StructType.fromDDL(schema)
    named = [dict(zip(fields.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, schema=to_arrow_schema(fields)), fields)


def rows_per_column(wide: DataFrame, names: list[str], metrics: list[str], keys: tuple = ()) -> DataFrame:
    """Turn one wide aggregate row (``metric_ordinal`` columns) into one row per column."""
    entries = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("column"), *[F.col(f"{m}_{i}").alias(m) for m in metrics])
        for i, n in enumerate(names)
    ]
    return wide.select(*[col(k) for k in keys], F.inline(F.array(*entries)))
