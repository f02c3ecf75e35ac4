"""Table and column profiles.

Every profile is built from at most three shared passes, whatever the number of columns:

* one wide aggregate for counts, means, deviations, minima and maxima;
* one frequency table per type family (``(ordinal, value) -> n``, combined before the shuffle),
  from which both distinct counts and top values come;
* percentiles, see :mod:`tabulon.operators.quantiles`.

Ties in rankings are broken by value or by column order, so results are reproducible.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.coerce import text_to_number, to_number
from tabulon.functions.columns import (
    as_text,
    categorical_columns,
    col,
    family,
    is_nested,
    is_numeric,
    numeric_columns,
    present,
    require_columns,
    rows_per_column,
    small_table,
)
from tabulon.operators.quantiles import fits_direct, percentile_expr, percentiles, sketches
from tabulon.session import staged

QUARTILES = [0.25, 0.5, 0.75]
NO_VALUES = "keine Werte"  # fixed value: text shown for a column without any value


def percent_text(share: Column, digits: int) -> Column:
    """``21.1%``; ``format_number`` rounds the exact binary value, half to even."""
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def row_column_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def schema_overview(df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark type and type family. No job on the data."""
    rows = [(i, f.name, f.dataType.simpleString(), family(f.dataType)) for i, f in enumerate(df.schema)]
    return small_table(df.sparkSession, rows, "ordinal int, column string, type string, family string")


# --- duplicates -----------------------------------------------------------------------------


# Timestamps keep their microseconds in JSON.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _row_values(df: DataFrame) -> list[Column]:
    """The cells of a row, ready to compare: NaN is NULL, -0.0 is 0.0, nested values are text."""
    values = []
    for f in df.schema:
        value = present(df, f.name)
        if is_nested(f.dataType):
            value = F.to_json(value, JSON_TIMES)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0)
        values.append(value.alias(f"k{len(values)}"))
    return values


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to another row, less one per distinct row (missing equals missing).

    Rows with text are compared by the SHA-256 of their JSON form, so 32 bytes per distinct row
    are shuffled however long the texts are; other rows are short and compared as they are.
    Copies are combined before the shuffle.
    """
    keyed = df.select(*_row_values(df))
    if any(isinstance(f.dataType, (T.StringType, T.BinaryType)) for f in keyed.schema):
        cells = F.to_json(F.struct(*keyed.columns), JSON_TIMES)
        keyed = keyed.select(F.unhex(F.sha2(cells, 256)).alias("digest"))
    copies = keyed.groupBy(*keyed.columns).count()
    return copies.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


# --- missing values -------------------------------------------------------------------------


def missing_by_column(df: DataFrame) -> DataFrame:
    """``(ordinal, column, missing, share, percent, share_text)``; one pass, count only."""
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(present(df, n)).alias(f"filled_{i}") for i, n in enumerate(df.columns)],
    )
    wide = wide.select(
        *[(F.col("rows") - F.col(f"filled_{i}")).alias(f"missing_{i}") for i in range(len(df.columns))],
        *[
            F.coalesce(F.try_divide(F.col("rows") - F.col(f"filled_{i}"), F.col("rows")), F.lit(0.0)).alias(f"share_{i}")
            for i in range(len(df.columns))
        ],
    )
    rows = rows_per_column(wide, df.columns, ["missing", "share"])
    return rows.select(
        "*",
        F.round(F.col("share") * 100, 2).alias("percent"),
        percent_text(F.col("share"), 1).alias("share_text"),
    )


def missing_ranking(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Columns by missing values, most first; equal counts keep column order."""
    rows = missing_by_column(df).withColumn("share_text", percent_text(F.col("share"), 2))
    if only_missing:
        rows = rows.where("missing > 0")
    return rows.orderBy(F.desc("missing"), "ordinal")


# --- frequencies ----------------------------------------------------------------------------


def _stacked(df: DataFrame, names: list[str], slots) -> DataFrame:
    """``(ordinal, *slots)``, one row per cell that holds a value; ``slots(name)`` gives the columns."""
    ordinals = {n: i for i, n in enumerate(df.columns)}
    cells = []
    for n in names:
        cells += [F.lit(ordinals[n]), *slots(n)]
    return df.select(F.stack(F.lit(len(names)), *cells))


def number_frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """``(ordinal, whole, real, n)``: integers and dates stay exact, fractions stay doubles."""

    def slots(name: str) -> list[Column]:
        data_type = df.schema[name].dataType
        value = present(df, name)
        if isinstance(data_type, (T.FloatType, T.DoubleType)):
            return [F.lit(None).cast("decimal(38,10)"), value.cast("double")]
        return [value.cast("decimal(38,10)"), F.lit(None).cast("double")]

    exact = any(isinstance(df.schema[n].dataType, T.DecimalType) for n in names)

    def narrow(name: str) -> list[Column]:
        data_type = df.schema[name].dataType
        value = present(df, name)
        if isinstance(data_type, (T.FloatType, T.DoubleType)):
            return [F.lit(None).cast("bigint"), value.cast("double")]
        if isinstance(data_type, T.DateType):
            value = F.unix_date(value)
        elif isinstance(data_type, T.TimestampType):
            value = F.unix_micros(value)
        elif isinstance(data_type, T.TimestampNTZType):
            value = F.unix_micros(value.cast("timestamp"))
        return [value.cast("bigint"), F.lit(None).cast("double")]

    cells = _stacked(df, names, slots if exact else narrow).toDF("ordinal", "whole", "real")
    filled = cells.where("whole IS NOT NULL OR real IS NOT NULL")
    return filled.groupBy("ordinal", "whole", "real").agg(F.count(F.lit(1)).alias("n"))


def text_frequencies(df: DataFrame, names: list[str]) -> DataFrame:
    """``(ordinal, value, n)`` over values in text form; long texts by their key (see :func:`_keyed`)."""

    def slots(name: str) -> list[Column]:
        return [_keyed(as_text(df, name))]

    cells = _stacked(df, names, slots).toDF("ordinal", "value")
    return cells.where("value IS NOT NULL").groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))


def _split_by_slot(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Column names by frequency table: plain numbers and dates, decimals, everything as text."""
    plain, decimals, text = [], [], []
    for f in df.schema:
        if isinstance(f.dataType, T.DecimalType) and f.dataType.scale <= 10 and f.dataType.precision - f.dataType.scale <= 28:
            decimals.append(f.name)
        elif (is_numeric(f.dataType) and not isinstance(f.dataType, T.DecimalType)) or isinstance(
            f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)
        ):
            plain.append(f.name)
        else:
            text.append(f.name)
    return plain, decimals, text


def _named(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Attach column names to ordinals: a CASE over the schema, not a join."""
    names = F.array(*[F.lit(n) for n in df.columns])
    return counts.select("*", F.element_at(names, F.col("ordinal") + 1).alias("column"))


SHORT_TEXT = 60  # longer texts are told apart by their beginning and SHA-256


def distinct_by_column(df: DataFrame, approx: bool = False) -> DataFrame:
    """``(ordinal, column, distinct)`` without missing values; exact unless ``approx``."""
    if approx:
        wide = df.agg(*[F.approx_count_distinct(present(df, n)).alias(f"distinct_{i}") for i, n in enumerate(df.columns)])
        return rows_per_column(wide, df.columns, ["distinct"])
    plain, decimals, text = _split_by_slot(df)
    tables = [number_frequencies(df, part) for part in (plain, decimals) if part]
    if text:
        tables.append(text_frequencies(df, text))
    return _with_empty_columns(df, [t.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct")) for t in tables])


def _with_empty_columns(df: DataFrame, counts: list[DataFrame]) -> DataFrame:
    """Columns without any value have no frequency row; give them a zero."""
    zeros = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("ordinal"), F.lit(0).cast("bigint").alias("distinct"))
    merged = reduce(DataFrame.unionByName, counts, zeros).groupBy("ordinal").agg(F.max("distinct").alias("distinct"))
    return _named(df, merged).select("ordinal", "column", "distinct")


def _keyed(value: Column) -> Column:
    """What a text is counted by: its first ``SHORT_TEXT`` characters, and the SHA-256 of a longer one."""
    return F.when(F.length(value) > SHORT_TEXT, F.concat(F.left(value, F.lit(SHORT_TEXT)), F.sha2(value, 256))).otherwise(value)


def _top(df: DataFrame, frequencies: DataFrame, names: list[str], k: int) -> DataFrame:
    """The k most frequent values per column; equal counts by their first characters, then by digest.

    Spark limits every task's output to k rows per column before the shuffle (window group limit), so no task
    holds a column's values. Only then the texts behind the k keys are looked up: a long text is no grouping key.
    """
    rank = F.row_number().over(Window.partitionBy("ordinal").orderBy(F.desc("n"), "value"))
    best = frequencies.withColumn("rank", rank).where(F.col("rank") <= k)
    short = best.where(F.length("value") <= SHORT_TEXT)
    long = best.where(F.length("value") > SHORT_TEXT).withColumnRenamed("value", "key")

    def slots(name: str) -> list[Column]:
        value = as_text(df, name)
        return [F.when(F.length(value) > SHORT_TEXT, value)]

    cells = _stacked(df, names, slots).toDF("ordinal", "value").where("value IS NOT NULL")
    found = cells.join(F.broadcast(long), (cells["ordinal"] == long["ordinal"]) & (_keyed(cells["value"]) == long["key"]))
    texts = found.groupBy(long["ordinal"], "n", "rank", "key").agg(F.first("value").alias("value"))
    return short.select("ordinal", "value", "n", "rank").unionByName(texts.select("ordinal", "value", "n", "rank"))


def top_values(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """``(ordinal, column, rank, value, n)`` for text, boolean and nested columns."""
    names = categorical_columns(df) if columns is None else columns
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, rank int, value string, n bigint")
    return _named(df, _top(df, text_frequencies(df, names), names, k)).select("ordinal", "column", "rank", "value", "n")


def top_values_text(
    df: DataFrame, k: int = 3, pattern: str = "%s (%d)", separator: str = ", ", columns: list[str] | None = None
) -> DataFrame:
    """``(ordinal, column, top)``: the top values as one text per column."""
    names = categorical_columns(df) if columns is None else columns
    ordinals = {n: i for i, n in enumerate(df.columns)}
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, top string")
    all_names = small_table(df.sparkSession, [(ordinals[n], n) for n in names], "ordinal int, column string")
    top = top_values(df, k, names)
    listed = top.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("items"))
    joined = F.array_join(F.transform("items", lambda t: F.format_string(pattern, t["value"], t["n"])), separator)
    return all_names.join(listed, "ordinal", "left").select(
        "ordinal", "column", F.coalesce(joined, F.lit(NO_VALUES)).alias("top")
    )


# --- describe -------------------------------------------------------------------------------

DESCRIBE = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def describe_numeric(
    df: DataFrame,
    columns: list[str] | None = None,
    keys: tuple[str, ...] = (),
    digits: int | None = None,
    approx: bool = False,
    direct_rows: int | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles (linear) and maximum per numeric column.

    With ``keys`` the same per group; rows with a missing key belong to no group.
    """
    names = [n for n in (numeric_columns(df) if columns is None else columns) if n not in keys]
    require_columns(df, names, numeric=True)
    keys = tuple(keys)
    if keys:
        df = df.where(reduce(Column.__and__, [present(df, k).isNotNull() for k in keys]))
    direct = approx or fits_direct(df, direct_rows)
    aggregates = []
    for i, n in enumerate(names):
        value = present(df, n).cast("double")
        aggregates += [
            F.count(value).alias(f"count_{i}"),
            F.avg(value).alias(f"mean_{i}"),
            F.stddev_samp(value).alias(f"std_{i}"),
            F.min(value).alias(f"min_{i}"),
            F.max(value).alias(f"max_{i}"),
        ]
        if direct:
            aggregates.append(percentile_expr(value, QUARTILES, approx).alias(f"q_{i}"))
    metrics = ["count", "mean", "std", "min", "max"]
    if direct:
        wide = df.groupBy(*[col(k) for k in keys]).agg(*aggregates)
        rows = rows_per_column(wide, names, [*metrics, "q"], keys)
    else:
        # The sketches that the percentiles start from come out of the same scan.
        wide = df.groupBy(*[col(k) for k in keys]).agg(*aggregates, *sketches(df, names, QUARTILES))
        if keys:
            sketch = wide = staged(wide, "described")
        else:
            sketch = wide.first()
            figures = [(i, n, *(sketch[f"{m}_{i}"] for m in metrics)) for i, n in enumerate(names)]
        quartiles = percentiles(df, names, QUARTILES, keys, direct_rows=-1, sketch=sketch)
        if keys:
            rows = rows_per_column(wide, names, metrics, keys)
        else:
            rows = small_table(df.sparkSession, figures, "ordinal int, column string, count bigint, mean double, std double, min double, max double")
        rows = rows.join(quartiles, [*keys, "column"], "left")
    rows = rows.withColumns({f"p{int(p * 100)}": F.get("q", F.lit(i)) for i, p in enumerate(QUARTILES)})
    shown = [F.col("count")] + [(F.round(m, digits) if digits is not None else F.col(m)).alias(m) for m in DESCRIBE[1:]]
    return rows.select(*[col(k) for k in keys], "ordinal", "column", *shown)


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(ordinal, column, count, unique, top, freq)`` per text, boolean or nested column."""
    names = categorical_columns(df) if columns is None else columns
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, count bigint, unique bigint, top string, freq bigint")
    frequencies = text_frequencies(df, names)
    totals = frequencies.groupBy("ordinal").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"))
    first = _top(df, frequencies, names, 1).select("ordinal", F.col("value").alias("top"), F.col("n").alias("freq"))
    return _named(df, totals.join(first, "ordinal")).select("ordinal", "column", "count", "unique", "top", "freq")


# --- combined profiles ----------------------------------------------------------------------


def column_profile(df: DataFrame) -> DataFrame:
    """``(ordinal, column, type, family, missing, percent, share_text, distinct)``."""
    return (
        schema_overview(df)
        .join(missing_by_column(df).drop("column"), "ordinal")
        .join(distinct_by_column(df).drop("column"), "ordinal")
        .select("ordinal", "column", "type", "family", "missing", "percent", "share_text", "distinct")
    )


def basic_analysis(df: DataFrame, digits: int = 3) -> DataFrame:
    """Per column: family, missing and distinct counts, and the rounded statistics of numbers."""
    profile = column_profile(df).select("ordinal", "column", "family", "missing", "distinct")
    if not numeric_columns(df):
        return profile
    stats = describe_numeric(df, digits=digits).drop("ordinal")
    return profile.join(stats, "column", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint"))


def _long(df: DataFrame, section: str, metrics: dict[str, Column], text: dict[str, Column]) -> DataFrame:
    entries = [F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(None).cast("string").alias("text")) for m, v in metrics.items()]
    entries += [F.struct(F.lit(m).alias("metric"), F.lit(None).cast("double").alias("value"), v.cast("string").alias("text")) for m, v in text.items()]
    return df.select(F.lit(section).alias("section"), "ordinal", "column", F.inline(F.array(*entries)))


def table_facts(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate rows, numeric and categorical column counts."""
    counts = {
        "columns": F.lit(len(df.columns)),
        "numeric_columns": F.lit(len(numeric_columns(df))),
        "categorical_columns": F.lit(len(categorical_columns(df))),
    }
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("rows", duplicate_rows(df).scalar().alias("duplicate_rows"), *[v.alias(n) for n, v in counts.items()])


SAMPLE_ROWS = 8  # fixed value: rows that a profile shows


def sample_rows(df: DataFrame, order: list[str] | None = None, n: int = SAMPLE_ROWS) -> DataFrame:
    """``(ordinal, row, text)``: ``n`` rows of the table cell by cell as text, the first by ``order`` (as they come if None); missing values are NULL."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "ordinal int, row int, text string")
    first = (df.orderBy(*[col(c) for c in order]) if order else df).limit(n)
    place = Window.orderBy(*[col(c) for c in order]) if order else Window.orderBy(F.monotonically_increasing_id())
    numbered = first.select(F.row_number().over(place).alias("row"), *[as_text(df, c).alias(f"t_{i}") for i, c in enumerate(df.columns)])
    cells = [x for i in range(len(df.columns)) for x in (F.lit(i), F.col(f"t_{i}"))]
    return numbered.select("row", F.stack(F.lit(len(df.columns)), *cells).alias("ordinal", "text")).select("ordinal", "row", "text")


def data_profile(
    df: DataFrame, source_name: str, k: int = 5, digits: int = 4, max_categorical: int | None = None, order: list[str] | None = None
) -> DataFrame:
    """The whole profile as one long table ``(source, section, ordinal, column, metric, value, text)``.

    Sections: ``table`` (counts, ordinal -1), ``column`` (missing, distinct, type), ``statistics``, ``top_values``
    and ``sample`` (the first rows by ``order``, one metric ``row n`` per cell). ``max_categorical`` limits the columns with top values.
    """
    facts = table_facts(df).select("*", F.lit(-1).alias("ordinal"), F.lit(None).cast("string").alias("column"))
    facts = _long(facts, "table", {m: F.col(m) for m in ("rows", "columns", "duplicate_rows", "numeric_columns", "categorical_columns")}, {})
    columns = _long(
        column_profile(df),
        "column",
        {"missing": F.col("missing"), "missing_percent": F.col("percent"), "distinct": F.col("distinct")},
        {"family": F.col("family")},
    )
    parts = [facts, columns]
    if numeric_columns(df):
        parts.append(_long(describe_numeric(df, digits=digits), "statistics", {m: F.col(m) for m in DESCRIBE}, {}))
    names = categorical_columns(df)[:max_categorical]
    if names:
        parts.append(_long(top_values_text(df, k, "%s: %d", "; ", names), "top_values", {}, {"top": F.col("top")}))
    cells = _named(df, sample_rows(df, order))
    parts.append(
        cells.select(
            F.lit("sample").alias("section"), "ordinal", "column", F.concat(F.lit("row "), F.col("row")).alias("metric"),
            F.lit(None).cast("double").alias("value"), "text",
        )
    )
    return reduce(DataFrame.unionByName, parts).select(F.lit(source_name).alias("source"), "*")


def overview(df: DataFrame, source_name: str, max_categorical: int | None = None) -> DataFrame:
    """The short profile: three top values per column, three digits, no sample rows, plus hints."""
    profile = data_profile(df, source_name, k=3, digits=3, max_categorical=max_categorical).where("section <> 'sample'")
    notes = overview_hints(df).select(
        F.lit(source_name).alias("source"),
        F.lit("hint").alias("section"),
        F.lit(-1).alias("ordinal"),
        "column",
        F.col("hint").alias("metric"),
        F.col("value").cast("double"),
        F.lit(None).cast("string").alias("text"),
    )
    return profile.unionByName(notes)


def overview_hints(df: DataFrame) -> DataFrame:
    """``(hint, column, value)`` for what the hard numbers show.

    ``duplicate_rows`` and ``most_missing`` appear only when the number is above zero;
    ``numeric_follow_ups`` and ``category_follow_ups`` when such columns exist.
    """
    spark = df.sparkSession
    duplicates = duplicate_rows(df).select(
        F.lit("duplicate_rows").alias("hint"), F.lit(None).cast("string").alias("column"), F.col("duplicate_rows").alias("value")
    )
    worst = missing_ranking(df, only_missing=True).limit(1).select(
        F.lit("most_missing").alias("hint"), "column", F.col("missing").alias("value")
    )
    kinds = {"numeric_follow_ups": len(numeric_columns(df)), "category_follow_ups": len(categorical_columns(df))}
    rest = small_table(spark, [(h, None, n) for h, n in kinds.items()], "hint string, column string, value bigint")
    return duplicates.unionByName(worst).unionByName(rest).where("value > 0")


# --- extremes and outliers ------------------------------------------------------------------


def extreme_rows(df: DataFrame, column: str, direction: str = "max") -> DataFrame:
    """All rows that hold the column's largest or smallest value, ties included.

    The extreme is a scalar subquery, so the plan is two scans and a filter: no sort, no join.
    Text counts as numbers when any value reads as a number, and as text otherwise.
    """
    require_columns(df, [column])
    pick = {"max": F.max, "min": F.min}[direction]
    data_type = df.schema[column].dataType
    if is_numeric(data_type) or family(data_type) in ("datetime", "other") or isinstance(data_type, T.BooleanType):
        value = present(df, column)
        return df.where(value == df.agg(pick(value).alias("best")).scalar())
    text = as_text(df, column)
    number = text_to_number(text)
    best_number = df.agg(pick(number).alias("best")).scalar()
    best_text = df.agg(pick(text).alias("best")).scalar()
    return df.where(F.when(best_number.isNotNull(), number == best_number).otherwise(text == best_text))


def numeric_if_any(df: DataFrame, column: str) -> bool:
    """Whether a text column holds at least one value that reads as a number."""
    return df.agg(F.count(to_number(df, column)).alias("n")).first()["n"] > 0


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """``(ordinal, column, lower, upper, outliers)``: values outside the quartile fences.

    The fences come from one quartile pass; the second pass counts against plain numbers. A column without
    values has no fences and 0 outliers.
    """
    names = numeric_columns(df) if columns is None else columns
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, lower double, upper double, outliers bigint")
    found = {r["column"]: r["q"] for r in percentiles(df, names, [0.25, 0.75]).collect()}
    aggregates = []
    for i, n in enumerate(names):
        if n not in found:
            none = F.first(F.lit(None).cast("double"))
            aggregates += [none.alias(f"lower_{i}"), none.alias(f"upper_{i}"), F.first(F.lit(0).cast("bigint")).alias(f"outliers_{i}")]
            continue
        q1, q3 = found[n]
        lower, upper = F.lit(q1 - factor * (q3 - q1)), F.lit(q3 + factor * (q3 - q1))
        value = present(df, n).cast("double")
        aggregates += [
            F.first(lower).alias(f"lower_{i}"),
            F.first(upper).alias(f"upper_{i}"),
            F.count_if((value < lower) | (value > upper)).alias(f"outliers_{i}"),
        ]
    return rows_per_column(df.agg(*aggregates), names, ["lower", "upper", "outliers"])
