"""Direct answers to questions about one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.questions import direction, named_column, route
from tabulon.operators.profile import extreme_rows, missing_ranking


def answer(df: DataFrame, prompt: str) -> DataFrame | None:
    """Columns by missing values, or the rows that hold a column's extreme; None for questions
    that are neither or that name no column."""
    text = F.lit(prompt)
    asked = df.sparkSession.range(1).select(
        route(text).alias("route"), direction(text).alias("direction"), named_column(text, df.columns).alias("target")
    ).first()
    if asked["route"] == "missing":
        return missing_ranking(df)
    if asked["route"] == "extreme" and asked["target"]:
        return extreme_rows(df, asked["target"], asked["direction"])
    return None
