"""Text to number and text to timestamp, where bad input is data rather than an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import as_text, col, is_numeric

# What counts as a number in text form.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# Layouts tried for text dates after ISO, one layout for a whole column, each with
# the shape a value must have (the shape test is cheap, a failing parse is not).
DATE_LAYOUTS = (
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("MM/dd/yyyy HH:mm:ss", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"),
    ("dd.MM.yyyy", r"^\d{2}\.\d{2}\.\d{4}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd/MM/yyyy HH:mm:ss", r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$"),
    ("dd.MM.yyyy HH:mm", r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}$"),
    ("dd.MM.yyyy HH:mm:ss", r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}$"),
    ("yyyy/MM/dd HH:mm:ss", r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Z][a-z]{2,} \d{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Z][a-z]{2,} \d{1,2}, \d{4}$"),
)
ISO_SHAPE = r"^\s*(\d{4}(-\d|\s*$)|\d{1,2}:\d{2})"
ANY_SHAPE = "^(?:" + "|".join(shape.removeprefix("^") for shape in (ISO_SHAPE, *(s for _, s in DATE_LAYOUTS))) + ")"


def text_to_number(value: Column) -> Column:
    """Double where the text is a number, NULL otherwise (``1d``, ``1_000``, ``0x10`` are not)."""
    return F.when(value.rlike(NUMBER_PATTERN), F.btrim(value, F.lit(" \t\n\r\f\x0b")).try_cast("double"))


def to_number(df: DataFrame, name: str) -> Column:
    """Any column as double; NULL where it cannot be read as a number."""
    data_type = df.schema[name].dataType
    if is_numeric(data_type) or isinstance(data_type, T.BooleanType):
        value = col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return text_to_number(as_text(df, name))


def coerce_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: to_number(df, n) for n in names})


def _timestamp_candidates(value: Column) -> list[Column]:
    iso = F.when(value.rlike(ISO_SHAPE), value).try_cast("timestamp")
    return [iso] + [F.try_to_timestamp(F.when(value.rlike(shape), value), F.lit(p)) for p, shape in DATE_LAYOUTS]


def date_like(value: Column) -> Column:
    """The value if it has the shape of any layout: one test in place of one per layout."""
    return F.when(value.rlike(ANY_SHAPE), value)


def layout_counts(values: dict[str, Column], shaped: dict[str, Column] | None = None) -> list[Column]:
    """Aggregates for :func:`chosen_layouts`: per column all values, and those that each layout reads (``shaped``: its ``date_like`` values)."""
    counts = []
    for i, (name, value) in enumerate(values.items()):
        counts.append(F.count(value).alias(f"n_{i}"))
        counts += [F.count(parsed).alias(f"p_{i}_{j}") for j, parsed in enumerate(_timestamp_candidates(shaped[name] if shaped else value))]
    return counts


def chosen_layouts(values: dict[str, Column], found) -> dict[str, Column]:
    """The timestamps of the columns that one layout reads throughout; the first such layout counts."""
    casts = {}
    for i, (name, value) in enumerate(values.items()):
        total = found[f"n_{i}"]
        for j, parsed in enumerate(_timestamp_candidates(value)):
            if total and found[f"p_{i}_{j}"] == total:
                casts[name] = parsed
                break
    return casts


def coerce_datetimes(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Cast text columns to timestamp, all or nothing per column.

    One aggregate counts, for every column and layout, the values that parse; a column is cast
    with the first layout that reads all of its values, and stays text when there is none.
    """
    if names is None:
        names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    values = {n: col(n) for n in names}
    casts = chosen_layouts(values, df.agg(*layout_counts(values)).first())
    return df.withColumns(casts) if casts else df
