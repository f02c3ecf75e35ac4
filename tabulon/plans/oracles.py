"""For each query that SQL can state, the same result in ANSI SQL over the same tables."""

from __future__ import annotations

from tabulon.functions import questions
from tabulon.plans.queries import CENTERS, FEATURES, INJECTED, LOG, PROMPT, SAVED_AT, SCALED_CENTERS, SMALL_FOREST, STORED_AT

COLUMNS = {
    "orders": {
        "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "category", "o_totalprice": "number",
        "o_orderdate": "datetime", "o_orderpriority": "category",
    },
    "customer": {
        "c_custkey": "number", "c_name": "category", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "category",
    },
    "lineitem": {
        "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number",
        "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "category",
        "l_linestatus": "category", "l_shipdate": "datetime",
    },
    "injected": {
        "l_orderkey": "number", "l_linenumber": "number", "qty_null": "number", "price_nan": "number", "disc_inf": "number",
        "empty_col": "number", "const_col": "number", "flag_null": "category", "qty_text": "category",
    },
}
DOUBLES = {"price_nan", "disc_inf", "empty_col", "const_col", "qty_null", "o_totalprice", "c_acctbal", "l_quantity", "l_extendedprice", "l_discount", "l_tax"}
INJECTED_SQL = f"SELECT l_orderkey, l_linenumber, {', '.join(f'{sql} AS {n}' for n, sql in INJECTED.items())} FROM lineitem"
WITH_INJECTED = f"WITH injected AS ({INJECTED_SQL}) "
TURNS = "SELECT conv_id AS chat_id, turn, role, text AS content FROM conversations"


def present(name: str) -> str:
    return f"CASE WHEN NOT isnan({name}) THEN {name} END" if name in DOUBLES else name


def finite(name: str) -> str:
    return f"CASE WHEN NOT isnan({name}) AND abs({name}) <> CAST('Infinity' AS DOUBLE) THEN {name} END"


def union(parts) -> str:
    return " UNION ALL ".join(parts)


def texts(words) -> str:
    return "(" + " OR ".join(f"contains(lower(prompt), '{w}')" for w in words) + ")"


def missing(table: str, digits: int, names=None) -> str:
    names = COLUMNS[table] if names is None else names
    return union(
        f"SELECT {i} AS ordinal, '{n}' AS \"column\", m AS missing, share, round(share * 100, 2) AS percent, "
        f"printf('%.{digits}f%%', share * 100) AS share_text "
        f"FROM (SELECT count(*) - count({present(n)}) AS m, (count(*) - count({present(n)})) / CAST(count(*) AS DOUBLE) AS share FROM {table})"
        for i, n in enumerate(names)
    )


def distinct(table: str) -> str:
    return union(
        f"SELECT {i} AS ordinal, '{n}' AS \"column\", count(DISTINCT {present(n)}) AS \"distinct\" FROM {table}"
        for i, n in enumerate(COLUMNS[table])
    )


def describe(table: str, names, digits: int, group: str = "") -> str:
    key, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    shown = {
        "mean": "avg(v)", "std": "stddev_samp(v)", "min": "min(v)", "p25": "quantile_cont(v, 0.25)",
        "p50": "quantile_cont(v, 0.5)", "p75": "quantile_cont(v, 0.75)", "max": "max(v)",
    }
    metrics = ", ".join(f"round({sql}, {digits}) AS {m}" for m, sql in shown.items())
    return union(
        f"SELECT {key}{i} AS ordinal, '{n}' AS \"column\", count(v) AS count, {metrics} "
        f"FROM (SELECT {key}CAST({present(n)} AS DOUBLE) AS v FROM {table}){by}"
        for i, n in enumerate(names)
    )


def numbers(table: str) -> list[str]:
    return [n for n, kind in COLUMNS[table].items() if kind == "number"]


def categories(table: str) -> list[str]:
    return [n for n, kind in COLUMNS[table].items() if kind == "category"]


def counted(table: str, names) -> str:
    """(ordinal, column, value, n, rank) of category columns."""
    ordinals = list(COLUMNS[table]) if table in COLUMNS else list(names)
    # Equal counts are ordered by the first 60 characters and then by the digest of longer texts.
    key = "CASE WHEN length({0}) > 60 THEN left({0}, 60) || sha256({0}) ELSE {0} END"
    return union(
        f"SELECT {ordinals.index(n)} AS ordinal, '{n}' AS \"column\", {n} AS value, count(*) AS n, "
        f"row_number() OVER (ORDER BY count(*) DESC, {key.format(n)}) AS rank FROM {table} WHERE {n} IS NOT NULL GROUP BY {n}"
        for n in names
    )


def top_text(table: str, names, k: int, pattern: str, separator: str) -> str:
    return (
        f"SELECT ordinal, \"column\", string_agg(printf('{pattern}', value, n), '{separator}' ORDER BY rank) AS top "
        f"FROM ({counted(table, names)}) WHERE rank <= {k} GROUP BY ordinal, \"column\""
    )


def column_profile(table: str) -> str:
    kinds = union(f"SELECT {i} AS ordinal, '{kind}' AS family" for i, kind in enumerate(COLUMNS[table].values()))
    return (
        f"SELECT m.ordinal, m.\"column\", k.family, m.missing, m.percent, m.share_text, d.\"distinct\" "
        f"FROM ({missing(table, 1)}) m JOIN ({distinct(table)}) d ON m.ordinal = d.ordinal JOIN ({kinds}) k ON k.ordinal = m.ordinal"
    )


def duplicates(table: str, names) -> str:
    keys = ", ".join(present(n) for n in names)
    return f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys})"


def profile_rows(source: str, table: str, names, k: int, digits: int, pattern: str = "%s: %d", separator: str = "; ") -> str:
    """The long profile of the columns ``names`` of a table (or CTE)."""
    kinds = [COLUMNS[table][n] for n in names]
    nums = [n for n, kind in zip(names, kinds) if kind == "number"]
    cats = [n for n, kind in zip(names, kinds) if kind == "category"]
    lead = f"SELECT '{source}' AS source"
    empty = "CAST(NULL AS VARCHAR)"
    facts = {
        "rows": f"(SELECT count(*) FROM {table})", "columns": str(len(names)), "duplicate_rows": f"({duplicates(table, names)})",
        "numeric_columns": str(len(nums)), "categorical_columns": str(len(cats)),
    }
    parts = [
        f"{lead}, 'table' AS section, -1 AS ordinal, {empty} AS \"column\", '{m}' AS metric, CAST({sql} AS DOUBLE) AS value, {empty} AS text"
        for m, sql in facts.items()
    ]
    for i, (n, kind) in enumerate(zip(names, kinds)):
        head = f"{lead}, 'column', {i}, '{n}'"
        parts += [
            f"{head}, 'missing', CAST(count(*) - count({present(n)}) AS DOUBLE), {empty} FROM {table}",
            f"{head}, 'missing_percent', round((count(*) - count({present(n)})) / CAST(count(*) AS DOUBLE) * 100, 2), {empty} FROM {table}",
            f"{head}, 'distinct', CAST(count(DISTINCT {present(n)}) AS DOUBLE), {empty} FROM {table}",
            f"{head}, 'family', NULL, '{kind}'",
        ]
    for m in ("count", "mean", "std", "min", "p25", "p50", "p75", "max"):
        parts.append(f"{lead}, 'statistics', ordinal, \"column\", '{m}', CAST({m} AS DOUBLE), {empty} FROM ({describe(table, nums, digits)})")
    top = (
        f"SELECT \"column\", string_agg(printf('{pattern}', value, n), '{separator}' ORDER BY rank) AS top "
        f"FROM ({counted(table, cats)}) WHERE rank <= {k} GROUP BY \"column\""
    )
    for n in cats:
        parts.append(f"{lead}, 'top_values', {list(names).index(n)}, '{n}', 'top', NULL, top FROM ({top}) WHERE \"column\" = '{n}'")
    return union(parts)


def hints(table: str, names) -> str:
    nums = sum(COLUMNS[table][n] == "number" for n in names)
    cats = sum(COLUMNS[table][n] == "category" for n in names)
    return (
        f"SELECT * FROM (SELECT 'duplicate_rows' AS hint, CAST(NULL AS VARCHAR) AS \"column\", duplicate_rows AS value FROM ({duplicates(table, names)}) "
        f"UNION ALL (SELECT 'most_missing', \"column\", missing FROM ({missing(table, 2, names)}) ORDER BY missing DESC, ordinal LIMIT 1) "
        f"UNION ALL SELECT 'numeric_follow_ups', NULL, {nums} UNION ALL SELECT 'category_follow_ups', NULL, {cats}) WHERE value > 0"
    )


def pairs(names, table: str) -> str:
    return union(
        f"SELECT '{x}' AS column_x, '{y}' AS column_y, round(corr({present(x)}, {present(y)}), 6) AS correlation FROM {table}"
        for x in names
        for y in names
    )


NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
TITLE = f"coalesce(nullif(trim(left(trim(content, {BLANKS}), 70), {BLANKS}), ''), 'Gespeicherter Chat')"
FIRST = "SELECT chat_id, arg_min(content, turn) AS content, count(*) AS messages FROM turns GROUP BY chat_id"


def upserted() -> str:
    return (
        f"WITH turns AS ({TURNS}), stored AS (SELECT DISTINCT chat_id FROM turns WHERE role = 'system'), first AS ({FIRST}), "
        f"incoming AS (SELECT chat_id, bool_or(turn = 0 AND role = 'user') AS named FROM turns GROUP BY chat_id) "
        f"SELECT f.chat_id, CASE WHEN i.named THEN 'Neu' WHEN s.chat_id IS NOT NULL THEN 'Chat ' || s.chat_id ELSE {TITLE} END AS title, "
        f"'new.csv' AS source_name, CASE WHEN s.chat_id IS NOT NULL THEN '{STORED_AT}' ELSE '{SAVED_AT}' END AS created_at, "
        f"'{SAVED_AT}' AS updated_at, s.chat_id IS NOT NULL AS autosaved "
        f"FROM first f JOIN incoming i ON i.chat_id = f.chat_id LEFT JOIN stored s ON s.chat_id = f.chat_id"
    )


def named(columns) -> str:
    plain = "translate(lower(prompt), '`\"''', '')"
    compact = f"regexp_replace({plain}, '[\\s_\\-]+', '', 'g')"
    written = [f"CASE WHEN contains({plain}, '{c}') THEN '{c}' END" for c in columns]
    loose = [f"CASE WHEN contains({compact}, '{c.replace('_', '')}') THEN '{c}' END" for c in columns]
    return f"coalesce({', '.join(written + loose)})"


def context(messages: int, chars: int) -> str:
    return (
        f"SELECT chat_id, right(coalesce(string_agg(role || ': ' || content, chr(10) ORDER BY turn) FILTER (content <> ''), ''), {chars}) AS context FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC) AS back FROM (SELECT chat_id, turn, trim(role) AS role, trim(content) AS content FROM ({TURNS}))) "
        f"WHERE back <= {messages} GROUP BY chat_id"
    )


def truncated(value: str, limit: int) -> str:
    return f"CASE WHEN length({value}) <= {limit} THEN {value} ELSE rtrim(left({value}, {limit}), {BLANKS}) || chr(10) || '...[gekuerzt]' END"


def silhouette() -> str:
    distance = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
    return (
        f"WITH d AS (SELECT a.vec_id, a.label, b.label AS other, sum({distance}) AS s, count(*) AS m FROM embeddings a, embeddings b GROUP BY ALL), "
        "r AS (SELECT vec_id, label, max(CASE WHEN other = label THEN s / nullif(m - 1, 0) END) AS a, "
        "min(CASE WHEN other <> label THEN s / m END) AS b FROM d GROUP BY vec_id, label) "
        "SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM r GROUP BY label"
    )


def sample(source: str, table: str, key: str) -> str:
    """The first eight rows of a table, cell by cell."""
    first = f"(SELECT *, row_number() OVER (ORDER BY {key}) AS place FROM {table} ORDER BY {key} LIMIT 8)"
    return union(
        f"SELECT '{source}', 'sample', {i}, '{n}', 'row ' || place, CAST(NULL AS DOUBLE), CAST({n} AS VARCHAR) FROM {first}"
        for i, n in enumerate(COLUMNS[table])
    )


def silhouette_squared() -> str:
    """With squared distances a row's mean distance to a cluster needs the cluster's size, sums and squares only."""
    norm = "x * x + y * y"
    return (
        "WITH p AS (SELECT row_number() OVER () AS i, l_linenumber AS l, l_quantity AS x, l_extendedprice AS y FROM lineitem), "
        f"c AS (SELECT l, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum({norm}) AS sq FROM p GROUP BY l), "
        f"d AS (SELECT p.i, p.l, c.l AS o, c.n, c.n * ({norm}) - 2 * (x * sx + y * sy) + sq AS s FROM p, c), "
        "m AS (SELECT i, max(CASE WHEN l = o THEN s / (n - 1) END) AS a, min(CASE WHEN l <> o THEN s / n END) AS b FROM d GROUP BY i) "
        "SELECT count(*) AS n, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM m"
    )


def lloyd(points: str, centers, steps: int) -> str:
    """CTEs: steps of K-Means on ``points`` (with q and p) from given centres, written out; ``labelled`` has the label l after them."""
    start = ", ".join(f"CAST({x} AS DOUBLE) AS x{i}, CAST({y} AS DOUBLE) AS y{i}" for i, (x, y) in enumerate(centers))
    parts = [f"points AS ({points})", f"s0 AS (SELECT {start})"]
    for k in range(steps + 1):
        far = ", ".join(f"(q - x{i}) * (q - x{i}) + (p - y{i}) * (p - y{i}) AS d{i}" for i in range(3))
        label = "CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"
        name = "labelled" if k == steps else f"l{k}"
        parts.append(f"{name} AS (SELECT *, {label} AS l FROM (SELECT points.*, {far} FROM points, s{k}))")
        means = ", ".join(f"avg(q) FILTER (l = {i}) AS x{i}, avg(p) FILTER (l = {i}) AS y{i}" for i in range(3))
        parts.append(f"s{k + 1} AS (SELECT {means} FROM {name})")
    # Clusters are numbered by size, largest first.
    parts.append("numbered AS (SELECT l, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC) - 1 AS INT) AS cluster FROM labelled GROUP BY l)")
    return "WITH " + ", ".join(parts) + " "


def kmeans_lloyd() -> str:
    points = "SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem"
    return lloyd(points, CENTERS, 5) + (
        "SELECT cluster, count(*) AS n, round(avg(q), 4) AS l_quantity, round(avg(p), 4) AS l_extendedprice "
        "FROM labelled JOIN numbered USING (l) GROUP BY cluster"
    )


def cluster_report_given() -> str:
    scaled = ", ".join(f"(c.{n} - avg(c.{n}) OVER ()) / stddev_pop(c.{n}) OVER () AS {v}" for n, v in (("c_acctbal", "q"), ("c_nationkey", "p")))
    points = f"SELECT c_custkey, c_acctbal, c_nationkey, {scaled} FROM customer c"
    return lloyd(points, SCALED_CENTERS, 4) + "SELECT c_custkey, c_acctbal, c_nationkey, cluster FROM labelled JOIN numbered USING (l)"


def pca_lineitem() -> str:
    """The eigenvalues of a symmetric 3 x 3 matrix in closed form, the axes as cross products; an axis' largest loading is positive."""
    z = [f"(l.{n} - avg(l.{n}) OVER ()) / stddev_pop(l.{n}) OVER () AS z{i}" for i, n in enumerate(FEATURES)]
    pairs = {"a": (0, 0), "b": (1, 1), "c": (2, 2), "d": (0, 1), "e": (0, 2), "f": (1, 2)}
    cov = ", ".join(f"covar_samp(z{i}, z{j}) AS {k}" for k, (i, j) in pairs.items())
    axes = []
    for k, value in (("u", "big"), ("w", "middle")):
        axes.append(f"d * f - e * (b - {value}) AS {k}0, e * d - (a - {value}) * f AS {k}1, (a - {value}) * (b - {value}) - d * d AS {k}2")
    scale = lambda k: (
        f"(sqrt({k}0 * {k}0 + {k}1 * {k}1 + {k}2 * {k}2) * sign(CASE WHEN abs({k}0) >= abs({k}1) AND abs({k}0) >= abs({k}2) THEN {k}0 "
        f"WHEN abs({k}1) >= abs({k}2) THEN {k}1 ELSE {k}2 END))"
    )
    return (
        f"WITH z AS (SELECT l_orderkey, l_linenumber, {', '.join(z)} FROM lineitem l), m AS (SELECT {cov} FROM z), "
        "q AS (SELECT *, (a + b + c) / 3 AS t FROM m), "
        "p AS (SELECT *, sqrt(((a - t) * (a - t) + (b - t) * (b - t) + (c - t) * (c - t) + 2 * (d * d + e * e + f * f)) / 6) AS s FROM q), "
        "r AS (SELECT *, ((a - t) * ((b - t) * (c - t) - f * f) - d * (d * (c - t) - f * e) + e * (d * f - (b - t) * e)) / (2 * s * s * s) AS h FROM p), "
        "g AS (SELECT *, t + 2 * s * cos(acos(h) / 3) AS big, t + 2 * s * cos(acos(h) / 3 + 2 * pi() / 3) AS small FROM r), "
        f"v AS (SELECT {', '.join(axes)} FROM (SELECT *, 3 * t - big - small AS middle FROM g)) "
        f"SELECT l_orderkey, l_linenumber, round((z0 * u0 + z1 * u1 + z2 * u2) / {scale('u')}, 4) AS x, "
        f"round((z0 * w0 + z1 * w1 + z2 * w2) / {scale('w')}, 4) AS y FROM z, v"
    )


def forest_given() -> str:
    names = ("l_quantity", "l_extendedprice")
    paths = []
    for feature, cut, path in zip(*SMALL_FOREST):
        above = [f"{names[f]} > {c}" for f, c in zip(feature, cut)]
        paths.append(f"CASE WHEN NOT {above[0]} THEN CASE WHEN {above[1]} THEN {path[1]} ELSE {path[0]} END WHEN {above[2]} THEN {path[3]} ELSE {path[2]} END")
    usual = "(2.0 * (ln(CAST(255 AS DOUBLE)) + 0.5772156649) - 2.0 * 255 / 256)"
    return f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(-pow(2, -(CAST({paths[0]} AS DOUBLE) + {paths[1]}) / 2 / {usual}), 9) AS score FROM lineitem"


LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()


def statements() -> dict[str, str]:
    routes = {w: texts(getattr(questions, w)) for w in ("OVERVIEW_PHRASES", "DATA_WORDS", "CODE_WORDS", "MISSING_WORDS", "MOST_WORDS", "MAX_WORDS", "MIN_WORDS", "ROW_WORDS")}
    missing_route = f"({routes['MISSING_WORDS']} AND {routes['MOST_WORDS']})"
    extreme_route = f"(({routes['MAX_WORDS']} OR {routes['MIN_WORDS']}) AND {routes['ROW_WORDS']})"
    prompts = f"(SELECT conv_id, turn, {PROMPT} AS prompt FROM conversations)"
    feature_values = {n: finite(n) for n in ("qty_null", "price_nan", "disc_inf")}
    cleaned = ", ".join(f"{sql} AS {n}" for n, sql in feature_values.items())
    imputed = f"SELECT l_orderkey, l_linenumber, const_col, {', '.join(f'coalesce({n}, median({n}) OVER ()) AS {n}' for n in feature_values)} FROM (SELECT l_orderkey, l_linenumber, const_col, {cleaned} FROM injected)"
    scaled = ", ".join(f"round(({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER (), 4) AS {n}" for n in feature_values)
    nearest = [f"(l_quantity - {a}) * (l_quantity - {a}) + (l_extendedprice - {b}) * (l_extendedprice - {b})" for a, b in CENTERS]
    price_cut = "(SELECT quantile_cont(-l_extendedprice, 0.06) FROM lineitem)"
    fences = {n: f"(SELECT quantile_cont({n}, 0.25) AS a, quantile_cont({n}, 0.75) AS b FROM lineitem)" for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}
    quoted_name = "replace(c_name, '#', '\"')"
    encoded_name = "replace(replace(s_name, '#', '%23'), ' ', '+')"
    return {
        "row_column_counts": f"SELECT count(*) AS rows, {len(COLUMNS['lineitem'])} AS columns FROM lineitem",
        "duplicate_rows": duplicates("documents", ["text", "lang"]),
        "duplicate_rows_missing": WITH_INJECTED + duplicates("injected", ["qty_null", "price_nan", "flag_null"]),
        "missing_by_column": WITH_INJECTED + missing("injected", 1),
        "missing_ranking": WITH_INJECTED + missing("injected", 2),
        "distinct_by_column": distinct("orders"),
        "distinct_by_column_missing": WITH_INJECTED + distinct("injected"),
        "describe_numeric": describe("lineitem", numbers("lineitem"), 4),
        "describe_numeric_missing": WITH_INJECTED + describe("injected", ["qty_null", "price_nan", "empty_col", "const_col"], 4),
        "describe_grouped": describe("lineitem", ["l_quantity", "l_extendedprice"], 4, "l_returnflag"),
        "describe_categorical": WITH_INJECTED
        + f"SELECT ordinal, \"column\", CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", max(CASE WHEN rank = 1 THEN value END) AS top, max(n) AS freq FROM ({counted('injected', categories('injected'))}) GROUP BY ordinal, \"column\"",
        "top_values": f"SELECT ordinal, \"column\", CAST(rank AS INT) AS rank, value, n FROM ({counted('orders', categories('orders'))}) WHERE rank <= 5",
        "top_values_text": "SELECT ordinal + 1 AS ordinal, \"column\", top FROM (" + top_text("documents", ["text", "lang", "source"], 3, "%s (%d)", ", ") + ")",
        "column_profile": column_profile("orders"),
        "basic_analysis": f"SELECT p.ordinal, p.\"column\", p.family, p.missing, p.\"distinct\", coalesce(s.count, 0) AS count, s.mean, s.std, s.min, s.p25, s.p50, s.p75, s.max FROM ({column_profile('customer')}) p LEFT JOIN ({describe('customer', numbers('customer'), 3)}) s ON s.\"column\" = p.\"column\"",
        "data_profile": profile_rows("customer", "customer", list(COLUMNS["customer"]), 5, 4) + " UNION ALL " + sample("customer", "customer", "c_custkey"),
        "overview": WITH_INJECTED
        + profile_rows("lineitem", "injected", list(COLUMNS["injected"]), 3, 3)
        + " UNION ALL SELECT 'lineitem', 'hint', -1, \"column\", hint, CAST(value AS DOUBLE), NULL FROM ("
        + hints("injected", list(COLUMNS["injected"]))
        + ")",
        "overview_hints": WITH_INJECTED + hints("injected", list(COLUMNS["injected"])),
        "extreme_rows_max": "SELECT * FROM part WHERE p_retailprice = (SELECT max(p_retailprice) FROM part)",
        "extreme_rows_min": WITH_INJECTED + f"SELECT l_orderkey, l_linenumber, price_nan FROM injected WHERE price_nan = (SELECT min({present('price_nan')}) FROM injected)",
        "extreme_rows_text": "SELECT * FROM part WHERE p_name = (SELECT min(p_name) FROM part)",
        "extreme_rows_coerced": WITH_INJECTED + "SELECT l_orderkey, l_linenumber, qty_text FROM injected WHERE TRY_CAST(qty_text AS DOUBLE) = (SELECT max(TRY_CAST(qty_text AS DOUBLE)) FROM injected)",
        "iqr_outliers": union(
            f"SELECT {i} AS ordinal, '{n}' AS \"column\", round(any_value(a - 0.5 * (b - a)), 4) AS lower, round(any_value(b + 0.5 * (b - a)), 4) AS upper, "
            f"count(*) FILTER ({n} < a - 0.5 * (b - a) OR {n} > b + 0.5 * (b - a)) AS outliers FROM lineitem, {sub}"
            for i, (n, sub) in enumerate(fences.items())
        ),
        "numeric_coerce": WITH_INJECTED + f"SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(qty_text, '{NUMBER}') THEN TRY_CAST(qty_text AS DOUBLE) END AS qty_text FROM injected",
        "profile_states_merged": " UNION ALL ".join(
            f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, count({c}) AS count, round(avg({c}), 4) AS mean, "
            f"round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"
            for i, c in enumerate(LINEITEM[:8])
        ),
        "column_profile_types": "WITH types AS (SELECT row_number() OVER () - 1 AS ordinal, column_name, column_type FROM (DESCRIBE lineitem)), counts AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values FROM lineitem" for c in LINEITEM)
        + ") SELECT CAST(ordinal AS INTEGER) AS ordinal, column_name AS \"column\", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
        "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'timestamp' END AS type, missing, distinct_values AS \"distinct\" FROM types JOIN counts USING (column_name)",
        "datetime_layouts": "SELECT o_orderkey, "
        + ", ".join(f"CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS {n}" for n in ("us", "compact", "german", "slashes", "european", "short", "long"))
        + ", CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y%m%d') END AS mixed FROM orders",
        "datetime_coerce": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS date_ok, CASE WHEN o_orderkey = 7 THEN 'x' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_bad FROM orders",
        "filter_sort_top": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
        "group_aggregate": WITH_INJECTED
        + "SELECT flag_null, count(*) AS size, count(qty_null) AS count_qty_null, sum(qty_null) AS sum_qty_null, round(avg(qty_null), 4) AS mean_qty_null, median(qty_null) AS median_qty_null, "
        "round(stddev_samp(qty_null), 4) AS std_qty_null, min(qty_null) AS min_qty_null, max(qty_null) AS max_qty_null, count(DISTINCT qty_null) AS nunique_qty_null FROM injected WHERE flag_null IS NOT NULL GROUP BY flag_null",
        "summary": WITH_INJECTED + "SELECT round(avg(v), 4) AS mean_price_nan, round(median(v), 4) AS median_price_nan, round(stddev_samp(v), 4) AS std_price_nan FROM (SELECT " + present("price_nan") + " AS v FROM injected)",
        "pivot_sum": "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS \"F\", sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS \"O\" FROM lineitem GROUP BY l_returnflag",
        "correlation_matrix": WITH_INJECTED + pairs(["l_linenumber", "qty_null", "price_nan"], "injected"),
        "regression_line": WITH_INJECTED
        + "SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 8) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n "
        + f"FROM (SELECT qty_null AS x, {present('price_nan')} AS y FROM injected)",
        "histogram": "WITH e AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders), b AS (SELECT unnest(range(1, 11)) AS bin), "
        "c AS (SELECT least(CAST(floor((o_totalprice - low) / ((high - low) / 10)) AS INT) + 1, 10) AS bin, count(*) AS n FROM orders, e GROUP BY 1) "
        "SELECT CAST(b.bin AS INT) AS bin, round(low + (b.bin - 1) * ((high - low) / 10), 4) AS lower, round(low + b.bin * ((high - low) / 10), 4) AS upper, coalesce(c.n, 0) AS n FROM b LEFT JOIN c ON c.bin = b.bin, e",
        "scatter_points": WITH_INJECTED + "SELECT qty_null AS x, price_nan AS y FROM injected WHERE qty_null IS NOT NULL AND NOT isnan(price_nan)",
        "apply_user_function": "SELECT o_orderkey, CAST(floor(o_totalprice / 10000) AS BIGINT) AS price_class FROM orders",
        "apply_whole_groups": "SELECT o_custkey, count(*) AS n, max(gap) AS gap FROM (SELECT o_custkey, coalesce(date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), CAST(o_orderdate AS DATE)), 0) AS gap FROM orders) GROUP BY o_custkey",
        "apply_group_function": "SELECT o_orderpriority, CAST(sum(o_custkey * o_custkey) AS BIGINT) AS squares, count(*) AS n FROM orders GROUP BY o_orderpriority",
        "drop_empty_columns": WITH_INJECTED + "SELECT l_orderkey, l_linenumber, qty_null, const_col FROM injected",
        "clean_features": WITH_INJECTED + f"SELECT l_orderkey, l_linenumber, {cleaned} FROM injected",
        "impute_median": WITH_INJECTED + f"SELECT l_orderkey, l_linenumber, {', '.join(feature_values)} FROM ({imputed})",
        "standardize": WITH_INJECTED + f"SELECT l_orderkey, l_linenumber, {scaled}, CAST(0 AS DOUBLE) AS const_col FROM ({imputed})",
        "kmeans_assign": f"SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM (SELECT *, {', '.join(f'{d} AS d{i}' for i, d in enumerate(nearest))} FROM lineitem)",
        "cluster_sizes": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
        "cluster_profile": WITH_INJECTED + f"SELECT flag_null, round(avg(qty_null), 3) AS qty_null, round(avg({present('price_nan')}), 3) AS price_nan FROM injected WHERE flag_null IS NOT NULL GROUP BY flag_null",
        "silhouette_euclidean": silhouette(),
        "silhouette_squared": silhouette_squared(),
        "kmeans_lloyd": kmeans_lloyd(),
        "cluster_report_given": cluster_report_given(),
        "pca_lineitem": pca_lineitem(),
        "forest_given": forest_given(),
        "contamination_cut": f"SELECT l_orderkey, l_linenumber, -l_extendedprice AS score, round(-l_extendedprice - {price_cut}, 4) AS anomaly_score, -l_extendedprice - {price_cut} < 0 AS is_anomaly, CASE WHEN -l_extendedprice - {price_cut} < 0 THEN -1 ELSE 1 END AS anomaly_prediction FROM lineitem",
        "conv_clean": f"SELECT chat_id, turn, trim(role) AS role, trim(content) AS content FROM ({TURNS}) WHERE trim(role) <> '' AND trim(content) <> ''",
        "conv_load_clean": f"SELECT chat_id, turn, trim(role) AS role, trim(content) AS content FROM ({TURNS}) WHERE trim(role) IN ('user', 'assistant') AND trim(content) <> ''",
        "conv_records": f"WITH turns AS ({TURNS}), first AS ({FIRST}) SELECT chat_id, {TITLE} AS title, 'orders.csv' AS source_name, '{SAVED_AT}' AS created_at, '{SAVED_AT}' AS updated_at, FALSE AS autosaved, messages FROM first",
        "conv_preview": f"WITH t AS (SELECT chat_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS lines FROM ({TURNS}) WHERE content <> '' GROUP BY chat_id) SELECT chat_id, {truncated('lines', 900)} AS preview FROM t",
        "conv_recent_context": context(8, 3000),
        "conv_recent_context_short": context(3, 500),
        "conv_upsert": upserted(),
        "conv_list": upserted() + " ORDER BY updated_at DESC, f.chat_id",
        "conv_upsert_messages": f"SELECT chat_id, turn, role, content FROM ({TURNS}) WHERE role <> 'system' OR chat_id NOT IN (SELECT chat_id FROM ({TURNS}) WHERE role <> 'system')",
        "conv_store_lookup": f"SELECT chat_id, turn, role, content FROM ({TURNS}) WHERE chat_id IN (SELECT conv_id FROM conversations WHERE role = 'system')",
        "conv_compacted": f"SELECT chat_id, turn, role, content FROM ({TURNS}) WHERE role <> 'system'",
        "conv_delete": f"SELECT chat_id, turn, role, content FROM ({TURNS}) WHERE chat_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')",
        "conv_load": f"SELECT chat_id, turn, role, content FROM ({TURNS}) WHERE role IN ('user', 'assistant') AND chat_id IN (SELECT conv_id FROM conversations WHERE role = 'system')",
        "conv_source_mismatch": "SELECT doc_id, lang <> 'en' AND source <> 'src3' AS mismatch, lang = 'en' OR source <> 'src3' AS changed FROM documents",
        "conv_autosave_stream": f"WITH turns AS ({TURNS}), first AS ({FIRST}) SELECT t.chat_id, t.turn, t.role, t.content, (SELECT {TITLE} FROM first f WHERE f.chat_id = t.chat_id) AS title, 'orders.csv' AS source_name, TRUE AS autosaved FROM turns t",
        "prompt_routes": f"SELECT conv_id, turn, {routes['OVERVIEW_PHRASES']} AND {routes['DATA_WORDS']} AS overview, {routes['CODE_WORDS']} AS code, "
        f"CASE WHEN {missing_route} THEN 'missing' WHEN {extreme_route} THEN 'extreme' ELSE 'none' END AS route, "
        f"CASE WHEN NOT {missing_route} AND {extreme_route} THEN CASE WHEN {routes['MAX_WORDS']} THEN 'max' ELSE 'min' END END AS direction FROM {prompts}",
        "prompt_columns": f"SELECT conv_id, turn, CASE WHEN NOT {missing_route} AND {extreme_route} THEN {named(COLUMNS['orders'])} END AS target, {named(COLUMNS['orders'])} AS named FROM {prompts}",
        "answer_question": "SELECT * FROM supplier WHERE s_acctbal = (SELECT min(s_acctbal) FROM supplier)",
        "answer_missing": WITH_INJECTED + missing("injected", 2),
        "sanitize_names": "WITH s AS (SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '^(\\.*[^.].*)\\.[^.]*$', '\\1'), '[^a-zA-Z0-9_]+', '_', 'g'), '_')) AS n FROM pages) "
        "SELECT page_id, CASE WHEN n = '' THEN 'csv_tabelle' WHEN regexp_matches(n, '^[0-9]') THEN 't_' || n ELSE n END AS name FROM s",
        "quote_identifiers": f"SELECT c_custkey, '\"' || replace({quoted_name}, '\"', '\"\"') || '\"' AS quoted FROM customer",
        "connection_texts": "SELECT s_suppkey, 'PostgreSQL: ' || s_name || '@ö+@db.example.org:' || s_nationkey || '/' || s_name AS label, "
        f"'postgresql://' || {encoded_name} || ':p%40ss+w%2F@db.example.org:' || s_nationkey || '/d+b' AS url FROM supplier",
        "mask_secrets": "SELECT p_partkey, CASE WHEN p_name IS NULL OR p_name = '' THEN 'nicht gefunden' WHEN length(p_name) <= 8 THEN 'gefunden, aber sehr kurz' ELSE 'gefunden: ' || left(p_name, 4) || '…' || right(p_name, 4) END AS masked FROM part",
        "truncate_texts": f"SELECT doc_id, {truncated('text', 1500)} AS short FROM documents",
        "classify_errors": f"SELECT CASE WHEN contains(lower(log), 'model') AND contains(lower(log), 'not found') THEN 'model_not_found' WHEN contains(lower(log), 'iteration limit') OR contains(lower(log), 'time limit') THEN 'loop_limit' "
        f"WHEN contains(log, '500') OR contains(lower(log), 'internal server') OR contains(lower(log), 'server error') THEN 'server_error' ELSE 'other' END AS error_class, count(*) AS n FROM (SELECT {LOG} AS log FROM documents) GROUP BY 1",
        "warning_only": f"SELECT doc_id, contains(log, 'Warning:') AND NOT (contains(log, 'Traceback (most recent call last):') OR contains(log, 'Error:') OR contains(log, 'Exception:')) AS warning_only FROM (SELECT doc_id, {LOG} AS log FROM documents)",
        "figure_base64": "SELECT doc_id, to_base64(encode(text)) AS encoded, text AS decoded, text = '' OR NOT regexp_full_match(text, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') AS rejected FROM documents",
        "json_model_ids": "SELECT event_id, array_to_string(list_sort(list_distinct([event_type, 'm' || user_id, 'n', 'z'])), ',') AS ids FROM events",
        "model_catalogue": "SELECT DISTINCT unnest([event_type, 'm' || user_id, 'n', 'z']) AS id FROM events",
        "code_blocks": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'x = 1' || chr(10) || '  y = \"' || role || '\"' WHEN 1 THEN 'z = ' || conv_id ELSE 'n = ' || turn || chr(10) || 'print(n)' END AS code FROM conversations",
        "code_screen": "SELECT conv_id, turn, turn > 5 AS ok, CASE turn WHEN 0 THEN 'import' WHEN 1 THEN 'call' WHEN 2 THEN 'method' WHEN 3 THEN 'root' WHEN 4 THEN 'dunder' WHEN 5 THEN 'syntax' END AS rule, "
        "CASE turn WHEN 0 THEN 'os' WHEN 1 THEN 'open' WHEN 2 THEN 'to_csv' WHEN 3 THEN 'os' WHEN 4 THEN '__class__' END AS detail FROM conversations",
        "code_screen_replies": "SELECT conv_id, turn, turn > 5 AS ok, CASE turn WHEN 0 THEN 'import' WHEN 1 THEN 'call' WHEN 2 THEN 'method' WHEN 3 THEN 'root' WHEN 4 THEN 'dunder' WHEN 5 THEN 'syntax' END AS rule, "
        "CASE turn WHEN 0 THEN 'os' WHEN 1 THEN 'open' WHEN 2 THEN 'to_csv' WHEN 3 THEN 'os' WHEN 4 THEN '__class__' END AS detail FROM conversations",
        "csv_round_trip": "SELECT * FROM orders",
        "csv_round_trip_documents": "SELECT * FROM documents",
        "csv_single_file": "SELECT * FROM documents",
        "csv_schema_round_trip": "SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders",
        "csv_round_trip_conversations": "SELECT * FROM conversations",
        "csv_blanks": "SELECT conv_id, turn, '  ' || text || ' ' AS text FROM conversations",
        "json_arrays": "SELECT * FROM customer",
        "csv_missing_tokens": WITH_INJECTED + f"SELECT l_orderkey, l_linenumber, qty_null AS q, flag_null AS f, {present('price_nan')} AS p FROM injected",
        "json_round_trip": "SELECT * FROM customer",
        "chat_store_round_trip": TURNS,
        "append_rows": "SELECT * FROM orders UNION ALL SELECT * FROM orders",
    }
