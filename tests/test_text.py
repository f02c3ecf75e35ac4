import base64
import textwrap

import pytest
from pyspark.sql import functions as F

from tabulon.functions import code as C
from tabulon.functions import questions, text
from tabulon.functions.coerce import coerce_datetimes, coerce_numeric
from tabulon.plans.answer import answer


def apply(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_numbers_in_text(spark):
    cases = {
        " 12 ": 12.0, "1e3": 1000.0, "0x10": None, "1_000": None, "1,000": None, "inf": float("inf"), "Infinity": float("inf"),
        "nan": None, "": None, "+5": 5.0, ".5": 0.5, "5.": 5.0, "True": None, "1d": None, "5f": None, "12 3": None, "-inf": float("-inf"),
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "v string").withColumn("k", F.col("v"))
    found = {r["k"]: r["v"] for r in coerce_numeric(df, ["v"]).collect()}
    assert found == {**cases, None: None}


@pytest.mark.parametrize(
    "values,casts",
    [
        (["2024-01-01", "2024-02-01"], True), (["2024-01-01", None], True), (["2024", "2025"], True), (["1", "2"], False),
        (["a", "b"], False), (["2024-01-01", "01/02/2024"], False), (["01/02/2024", "12/31/2023"], True), ([None, None], False),
        (["2024-01-01T10:00:00", "2024-01-02 11:30:00"], True), (["31.12.2024"], True),
    ],
)
def test_dates_all_or_nothing(spark, values, casts):
    df = coerce_datetimes(spark.createDataFrame([(v,) for v in values], "v string"))
    assert (df.schema["v"].dataType.typeName() == "timestamp") == casts


def test_table_names(spark):
    cases = {
        "/a/b/Data Set-1.csv": "data_set_1", ".csv": "csv", "x.tar.gz": "x_tar", "a..csv": "a", "..csv": "csv", "a/": "csv_tabelle",
        "2024 x.xls": "t_2024_x", "Ümlaut.csv": "mlaut",
    }
    assert apply(spark, list(cases), text.sanitize_table_name) == list(cases.values())


def test_quote_mask_truncate(spark):
    assert apply(spark, ['a"b'], text.quote_identifier) == ['"a""b"']
    assert apply(spark, [None, "", "12345678", "123456789"], text.mask_secret) == [
        "nicht gefunden", "nicht gefunden", "gefunden, aber sehr kurz", "gefunden: 1234…6789",
    ]
    assert apply(spark, ["abc", "ab \u2003cd"], lambda c: text.truncate_text(c, 4)) == ["abc", "ab\n...[gekuerzt]"]


def test_strip_all_unicode_blanks(spark):
    assert apply(spark, [text.WHITESPACE + "x" + text.WHITESPACE], text.strip) == ["x"]


def test_figures(spark):
    long = "ä" * 200
    encoded = apply(spark, [long], lambda c: text.encode_figure(c.cast("binary")))[0]
    assert encoded == base64.b64encode(long.encode()).decode()
    decoded = apply(spark, [encoded, "YWJj", "abc", "YW Jj", "", "YQ=="], text.decode_figure)
    assert [None if d is None else bytes(d) for d in decoded] == [long.encode(), b"abc", None, None, None, b"a"]


def test_logs(spark):
    logs = ["UserWarning: x", "UserWarning: x\nTraceback (most recent call last):", "  ", "note", "ValueError: x Warning:"]
    assert apply(spark, logs, text.warning_only) == [True, False, False, False, False]
    errors = ["Model Not Found", "the model was not found", "iteration limit", "HTTP 500", "Internal Server", "boom"]
    assert apply(spark, errors, text.error_class) == [
        "model_not_found", "model_not_found", "loop_limit", "server_error", "server_error", "other",
    ]


def test_model_payloads(spark):
    payloads = ['{"data":[{"id":"b"},{"model":"a"},{"id":"","name":"c"},{"id":"b"},"d",5,{}]}', '[{"id":"a"}]', "no json", '{"x":1}', None]
    assert apply(spark, payloads, text.model_ids) == [["5", "a", "b", "c", "d"], [], [], [], []]


PROMPTS = [
    ("Gib mir die Zeile mit dem höchsten year_of_study", "extreme", "max", "year_of_study"),
    ("Gib mir die Zeile mit dem niedrigsten `year of study`", "extreme", "min", "year_of_study"),
    ("Welche Spalten haben die meisten fehlenden Werte?", "missing", None, None),
    ("Which column has the most null values?", "missing", None, None),
    ("Zeige die Spalten mit fehlenden Werten", "none", None, None),
    ("Was kannst du mir anhand dieser CSV sagen?", "none", None, None),
    ("Berechne die Korrelation als Diagramm", "none", None, None),
    ("Show the row with max and min price", "extreme", "max", "price"),
]


def test_prompt_routing(spark):
    df = spark.createDataFrame([(p[0],) for p in PROMPTS], "p string")
    rows = {r["p"]: r for r in questions.routed(df, "p", ["id", "year_of_study", "price"]).collect()}
    for prompt, route, direction, target in PROMPTS:
        found = rows[prompt]
        assert (found["route"], found["direction"], found["target"]) == (route, direction, target)
    assert [p for p in rows if rows[p]["overview"]] == [PROMPTS[5][0]]
    assert [p for p in rows if rows[p]["code"]] == [PROMPTS[6][0]]
    flags = df.select(*[f(F.col("p")) for f in (questions.route, questions.direction, questions.asks_overview, questions.asks_code)]).collect()
    assert [tuple(r) for r in flags] == [tuple(rows[p[0]][n] for n in ("route", "direction", "overview", "code")) for p in PROMPTS]


def test_first_column_wins_not_the_longest(spark):
    assert apply(spark, ["row with the highest price_total"], lambda c: questions.named_column(c, ["price", "price_total"])) == ["price"]


def test_answers(spark):
    df = spark.createDataFrame([(1, "5"), (2, "30"), (3, None)], "id int, price string")
    assert answer(df, "Zeile mit dem größten price").first()["id"] == 2
    assert answer(df, "Which columns have the most missing values?").first()["column"] == "price"
    assert answer(df, "row with the highest weight") is None
    assert answer(df, "Hallo") is None


REPLIES = [
    "Hi\n```python\n  1. x = 1\n  2. y = 2\n```\nbye",
    "```\n\timport os\n\n\tos.getcwd()\n```",
    "Here is code:\nprint(1)\n\nx=2",
    "x = 5",
    "just prose here",
    "a\n2) df.head()\nok",
    "```PYTHON\n    if a:\n        b\n\n    c = 1   \n```",
    "Antwort ist so\n1. result = 3\n```",
    "``` `x` ```",
]


def test_code_extraction(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, v string")
    found = [r["code"] for r in C.extract_code(df, "v").orderBy("i").collect()]
    assert found == [
        "x = 1\n  y = 2",
        "import os\n\n\tos.getcwd()",
        "print(1)\n\nx=2",
        "x = 5",
        "just prose here",
        "a\ndf.head()\nok",
        "if a:\n        b\n\n    c = 1",
        "result = 3",
        "x",
    ]


@pytest.mark.parametrize("block", ["  a\n   b\n", "\ta\n  b\n", "\t a\n\t b\n", "a\n  b", "   \n  x\n", "", "`\n  a\n    b\n"])
def test_dedent_is_exact(spark, block):
    lines = [line.rstrip() for line in block.splitlines()]
    column = F.split(F.lit("\n".join(lines)), "\n")
    found = spark.range(1).select(F.array_join(C._dedent(column), "\n")).first()[0]
    assert found == textwrap.dedent("\n".join(lines))


def test_code_screen(spark):
    cases = {
        "import os": "import", "open('x')": "call", "df.to_csv('x')": "method", "os.getcwd()": "root", "x.__class__": "dunder", "if a:": "syntax",
        "import pandas as pd\nresult = pd.DataFrame()": None, "from pathlib import Path": "import", "from . import x": "import",
        "eval('1')": "call", "__name__": "dunder", "import matplotlib.pyplot as plt": None, "sys.path": "root", "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    rows = {r["c"]: r for r in C.screen_code(df, "c").collect()}
    assert {c: rows[c]["rule"] for c in cases} == cases
    assert all(rows[c]["ok"] == (rule is None) for c, rule in cases.items())
