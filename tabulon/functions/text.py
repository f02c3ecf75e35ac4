"""Text, name and log functions as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace as stripped by the str methods of Python.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BASE64 = r"^[A-Za-z0-9+/]*={0,2}$"  # besides a length that is a multiple of four

# Texts that appear in results.
CUT_MARK = "\n...[gekuerzt]"
FIGURE_MARK = " [Diagramm]"
DEFAULT_TABLE_NAME = "csv_tabelle"
DEFAULT_TITLE = "Gespeicherter Chat"
SECRET_MISSING = "nicht gefunden"
SECRET_SHORT = "gefunden, aber sehr kurz"
SECRET_FOUND = "gefunden: "
TITLE_LENGTH = 70

# Markers in error texts and logs.
WARNING_MARKS = ("Warning:", "FutureWarning:", "DeprecationWarning:", "UserWarning:", "RuntimeWarning:")
ERROR_MARKS = ("Traceback (most recent call last):", "Error:", "Exception:")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def rstrip(value: Column) -> Column:
    return F.rtrim(value, F.lit(WHITESPACE))


def contains_any(value: Column, words) -> Column:
    """Whether any of ``words`` occurs in the text."""
    return reduce(Column.__or__, [F.contains(value, F.lit(w)) for w in words])


def filled(value: Column) -> Column:
    """NULL for empty or blank text."""
    return F.nullif(strip(value), F.lit(""))


def sanitize_table_name(name: Column) -> Column:
    """File path or name to a plain SQL name: no folder, no extension, ``[a-z0-9_]`` only."""
    base = F.regexp_replace(name, r"(?s)^.*/", "")
    stem = F.regexp_replace(base, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")
    plain = F.lower(F.btrim(F.regexp_replace(stem, r"[^a-zA-Z0-9_]+", "_"), F.lit("_")))
    return F.when(plain == "", F.lit(DEFAULT_TABLE_NAME)).when(plain.rlike("^[0-9]"), F.concat(F.lit("t_"), plain)).otherwise(plain)


def quote_identifier(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def connection_label(user: Column, host: Column, port: Column, database: Column) -> Column:
    return F.format_string("PostgreSQL: %s@%s:%s/%s", user, host, port.cast("string"), database)


def connection_url(user: Column, password: Column, host: Column, port: Column, database: Column) -> Column:
    """Connection URL with user, password and database quoted for use in a URL."""
    return F.format_string(
        "postgresql://%s:%s@%s:%s/%s", F.url_encode(user), F.url_encode(password), host, port.cast("string"), F.url_encode(database)
    )


def truncate_text(value: Column, max_chars: int = 5000) -> Column:
    """Text over the limit is cut there, right-trimmed and marked."""
    return F.when(F.length(value) <= max_chars, value).otherwise(F.concat(rstrip(F.left(value, F.lit(max_chars))), F.lit(CUT_MARK)))


def message_line(role: Column, content: Column, has_figure: Column) -> Column:
    """``role: content`` with a note when a figure belongs to the message."""
    mark = F.when(has_figure, F.lit(FIGURE_MARK)).otherwise("")
    return strip(F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(content, F.lit("")), mark))


def chat_title(title: Column, existing: Column, first_content: Column) -> Column:
    """New title before existing one before the start of the first message."""
    return F.coalesce(filled(title), filled(existing), filled(F.left(first_content, F.lit(TITLE_LENGTH))), F.lit(DEFAULT_TITLE))


def encode_figure(figure: Column) -> Column:
    """Base64 on one line (Spark's own function breaks it every 76 characters)."""
    return F.translate(F.base64(figure), "\r\n", "")


def decode_figure(text: Column) -> Column:
    """Strict base64; NULL for anything else."""
    strict = (text != "") & (F.length(text) % 4 == 0) & text.rlike(BASE64)
    return F.when(strict, F.try_to_binary(text, F.lit("base64")))


def mask_secret(value: Column) -> Column:
    shown = F.concat(F.lit(SECRET_FOUND), F.left(value, F.lit(4)), F.lit("…"), F.right(value, F.lit(4)))
    return (
        F.when(value.isNull() | (value == ""), SECRET_MISSING).when(F.length(value) <= 8, SECRET_SHORT).otherwise(shown)
    )


def error_class(text: Column) -> Column:
    """``model_not_found``, ``loop_limit``, ``server_error`` or ``other``, first match wins."""
    lower = F.lower(text)
    no_model = F.contains(lower, F.lit("model")) & F.contains(lower, F.lit("not found"))
    return (
        F.when(no_model, "model_not_found")
        .when(contains_any(lower, ("iteration limit", "time limit")), "loop_limit")
        .when(contains_any(lower, ("500", "internal server", "server error")), "server_error")
        .otherwise("other")
    )


def warning_only(log: Column) -> Column:
    """A log that holds warnings and no error."""
    return contains_any(log, WARNING_MARKS) & ~contains_any(log, ERROR_MARKS)


def model_ids(payload: Column) -> Column:
    """Sorted distinct model ids of a catalogue ``{"data": [...]}`` given as JSON text.

    Entries are objects (first filled of id, model, name) or plain values; anything else, a
    top-level list included, gives an empty array.
    """
    items = F.try_variant_get(F.try_parse_json(payload), "$.data", "array<variant>")

    def name(item: Column) -> Column:
        named = [F.nullif(F.try_variant_get(item, f"$.{k}", "string"), F.lit("")) for k in ("id", "model", "name")]
        is_object = F.schema_of_variant(item).startswith("OBJECT")
        return F.when(is_object, F.coalesce(*named)).otherwise(F.nullif(F.try_variant_get(item, "$", "string"), F.lit("")))

    found = F.filter(F.transform(items, name), lambda n: n.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))
