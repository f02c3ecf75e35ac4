"""What a question about a table asks for, as column expressions over a table of questions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import contains_any

# Word lists, matched as lower-case substrings.
OVERVIEW_PHRASES = (
    "was kannst du", "was siehst du", "was fällt auf", "was kann man", "erzähl mir", "sag mir etwas",
    "zusammenfassung", "überblick", "ueberblick", "summary", "overview", "eda", "explorative",
    "erste analyse", "kurze analyse", "anhand dieser csv", "anhand der csv", "über diese csv",
    "ueber diese csv", "über die daten", "ueber die daten", "zu dieser datei", "anhand dieser datei",
)
DATA_WORDS = ("csv", "datei", "daten", "datensatz", "tabelle", "dataframe", "dataset")
CODE_WORDS = (
    "ausfuehren", "ausführen", "berechne", "calculate", "chart", "code", "correlation", "diagramm",
    "durchschnitt", "filtere", "grafik", "groupby", "gruppiere", "histogramm", "korrelation", "median",
    "plot", "pivot", "python", "regression", "scatter", "sortiere", "standardabweichung", "verteilung",
    "visualisiere", "visualisierung",
)
MISSING_WORDS = ("fehlende", "missing", "null", "nan")
MOST_WORDS = ("meisten", "höchsten", "highest", "most")
MAX_WORDS = ("höchste", "höchsten", "max", "maximum", "größte", "größten", "highest", "largest")
MIN_WORDS = ("niedrigste", "niedrigsten", "min", "minimum", "kleinste", "kleinsten", "lowest", "smallest")
ROW_WORDS = ("zeile", "row", "datensatz", "record")
QUOTES = "`\"'"
SEPARATORS = r"[\s_\-]+"


def asks_overview(prompt: Column) -> Column:
    lower = F.lower(prompt)
    return contains_any(lower, OVERVIEW_PHRASES) & contains_any(lower, DATA_WORDS)


def asks_code(prompt: Column) -> Column:
    return contains_any(F.lower(prompt), CODE_WORDS)


def route(prompt: Column) -> Column:
    """``missing`` before ``extreme`` before ``none``."""
    lower = F.lower(prompt)
    missing = contains_any(lower, MISSING_WORDS) & contains_any(lower, MOST_WORDS)
    extreme = contains_any(lower, MAX_WORDS + MIN_WORDS) & contains_any(lower, ROW_WORDS)
    return F.when(missing, "missing").when(extreme, "extreme").otherwise("none")


def direction(prompt: Column) -> Column:
    """``max`` or ``min`` for extreme questions; ``max`` when both are asked for."""
    highest = contains_any(F.lower(prompt), MAX_WORDS)
    return F.when(route(prompt) == "extreme", F.when(highest, "max").otherwise("min"))


def normalized_prompt(prompt: Column) -> Column:
    return F.translate(F.lower(prompt), QUOTES, "")


def compact_prompt(prompt: Column) -> Column:
    return F.regexp_replace(normalized_prompt(prompt), SEPARATORS, "")


def named_column(prompt: Column, columns: list[str]) -> Column:
    """The first of ``columns``, in their order, that the prompt names.

    Names as written come before names compared without blanks, hyphens and underscores. A
    table's columns are schema, not data, so they sit in the expression and nothing is joined.
    """
    names = F.array(*[F.lit(c) for c in columns])
    text, compact = normalized_prompt(prompt), compact_prompt(prompt)
    written = F.filter(names, lambda n: F.contains(text, F.lower(n)))

    def loosely(name: Column) -> Column:
        short = F.regexp_replace(F.lower(name), SEPARATORS, "")
        return (short != "") & F.contains(compact, short)

    return F.coalesce(F.get(written, F.lit(0)), F.get(F.filter(names, loosely), F.lit(0)))


MANY_COLUMNS = 100  # beyond which names are looked up by an automaton


def _first_found(text: str, names: list[tuple[str, str]]) -> Column:
    """Of ``names`` (a pattern and the name it stands for) the first one, in their order, that the column ``text`` contains.

    All patterns are found in one pass over a text, by an Aho-Corasick automaton that each task builds once.
    """
    first: dict[str, int] = {}
    for number, (pattern, _) in enumerate(names):
        first.setdefault(pattern, number)
    everywhere = first.pop("", None)  # an empty name is in every text, but names nothing once blanks are left out
    if text != "_text":
        everywhere = None

    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern, number in first.items():
            automaton.add_word(pattern, number)
        automaton.make_automaton()
        for batch in batches:
            least = [None if t is None else min([n for _, n in automaton.iter(t)] + ([] if everywhere is None else [everywhere]), default=None) for t in batch]
            yield pd.Series([None if n is None else names[n][1] for n in least], dtype=object)

    return found(F.col(text))


def routed(prompts: DataFrame, prompt: str, columns: list[str]) -> DataFrame:
    """``prompts`` plus ``overview``, ``code``, ``route``, ``direction``, ``named`` (the column a
    prompt names) and ``target`` (the same, for extreme questions).

    Normalised texts and word tests are columns of their own first, so each is computed once.
    """
    entries = [
        F.struct(F.lit(c).alias("name"), F.lit(c.lower()).alias("text"), F.lit(re.sub(SEPARATORS, "", c.lower())).alias("short"))
        for c in columns
    ]

    def first_named(test) -> Column:
        if not entries:
            return F.lit(None).cast("string")
        return F.get(F.filter(F.array(*entries), test), F.lit(0))["name"]

    if len(columns) > MANY_COLUMNS:
        written = _first_found("_text", [(c.lower(), c) for c in columns])
        loose = _first_found("_compact", [(re.sub(SEPARATORS, "", c.lower()), c) for c in columns])
    else:
        written = first_named(lambda c: F.contains("_text", c["text"]))
        loose = first_named(lambda c: (c["short"] != "") & F.contains("_compact", c["short"]))

    lower = prompts.withColumn("_lower", F.lower(F.col(prompt)))
    texts = lower.withColumn("_text", F.translate("_lower", QUOTES, ""))
    texts = texts.withColumn("_compact", F.regexp_replace("_text", SEPARATORS, ""))
    tests = {
        "_missing": (MISSING_WORDS, MOST_WORDS),
        "_max": (MAX_WORDS, ROW_WORDS),
        "_min": (MIN_WORDS, ROW_WORDS),
        "overview": (OVERVIEW_PHRASES, DATA_WORDS),
    }
    flags = {n: contains_any(F.col("_lower"), a) & contains_any(F.col("_lower"), b) for n, (a, b) in tests.items()}
    flagged = texts.withColumns(
        {
            **flags,
            "code": contains_any(F.col("_lower"), CODE_WORDS),
            "_written": written,
            "_loose": loose,
        }
    )
    extreme = ~F.col("_missing") & (F.col("_max") | F.col("_min"))
    named = F.coalesce("_written", "_loose")
    return flagged.withColumns(
        {
            "route": F.when(F.col("_missing"), "missing").when(extreme, "extreme").otherwise("none"),
            "direction": F.when(extreme, F.when(F.col("_max"), "max").otherwise("min")),
            "named": named,
            "target": F.when(extreme, named),
        }
    ).drop("_lower", "_text", "_compact", "_missing", "_max", "_min", "_written", "_loose")
