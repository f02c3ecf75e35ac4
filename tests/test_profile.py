import math
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from plan_texts import plan
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.operators import profile as P
from tabulon.operators import quantiles as Q
from tabulon.operators.adhoc import group_aggregate, summary

NAN = float("nan")


def frame(spark, values, schema="x double"):
    return spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)


def test_describe_skips_nan(spark):
    row = P.describe_numeric(frame(spark, [1.0, 2.0, NAN, 10.0]), digits=4).first()
    assert (row["count"], row["mean"], row["std"], row["min"]) == (3, 4.3333, 4.9329, 1.0)
    assert (row["p25"], row["p50"], row["p75"], row["max"]) == (1.5, 2.0, 6.0, 10.0)


def test_describe_one_row_has_no_deviation(spark):
    assert P.describe_numeric(frame(spark, [3.0])).first()["std"] is None


def test_duplicates_missing_equals_missing(spark):
    assert P.duplicate_rows(frame(spark, [NAN, NAN, None, 1.0])).first()[0] == 2
    assert P.duplicate_rows(frame(spark, [0.0, -0.0])).first()[0] == 1
    assert P.duplicate_rows(frame(spark, [])).first()[0] == 0


def test_duplicates_with_text_nested_and_microseconds(spark):
    rows = [
        ("a", 0.0, {"k": 1}, [1, None], datetime(2024, 1, 1, 0, 0, 0, 1)),
        ("a", -0.0, {"k": 1}, [1, None], datetime(2024, 1, 1, 0, 0, 0, 1)),
        ("a", 0.0, {"k": 1}, [1, None], datetime(2024, 1, 1, 0, 0, 0, 2)),
        (None, NAN, None, None, None),
        (None, None, None, None, None),
        ("", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "s string, d double, m map<string,int>, a array<int>, t timestamp")
    assert P.duplicate_rows(df).first()[0] == 2


def test_missing_and_infinity(spark):
    row = P.missing_by_column(frame(spark, [NAN, None, float("inf"), 1.0])).first()
    assert (row["missing"], row["percent"], row["share_text"]) == (2, 50.0, "50.0%")
    assert P.missing_by_column(frame(spark, [])).first()["share"] == 0.0


def test_distinct_of_all_types(spark):
    df = spark.createDataFrame(
        [(1, NAN, "a", True, Decimal("1.50"), datetime(2024, 1, 1), [1]), (1, 0.0, "b" * 100, None, Decimal("1.50"), None, [2]),
         (2, -0.0, "b" * 100, False, None, None, None)],
        "i long, d double, s string, b boolean, n decimal(10,2), t timestamp, a array<int>",
    )
    found = {r["column"]: r["distinct"] for r in P.distinct_by_column(df).collect()}
    assert found == {"i": 2, "d": 1, "s": 2, "b": 2, "n": 1, "t": 1, "a": 2}


def test_large_integers_stay_distinct(spark):
    df = frame(spark, [2**53, 2**53 + 1], "x long")
    assert P.distinct_by_column(df).first()["distinct"] == 2


def test_top_values_ties_and_empty(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("a", None), ("b", None), ("c", None)], "s string, e string")
    assert [(r["value"], r["n"]) for r in P.top_values(df.select("s"), 2).orderBy("rank").collect()] == [("a", 2), ("b", 2)]
    assert {r["column"]: r["top"] for r in P.top_values_text(df, 2).collect()} == {"s": "a (2), b (2)", "e": "keine Werte"}


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b")], "`a.b` double, `c``d` string")
    assert {r["column"]: (r["missing"], r["distinct"]) for r in P.column_profile(df).collect()} == {"a.b": (1, 1), "c`d": (0, 2)}
    assert P.describe_numeric(df).first()["mean"] == 1.0


def test_extremes(spark):
    df = spark.createDataFrame([("3", 1), ("12", 2), ("x", 3), ("12", 4), (None, 5)], "v string, id int")
    assert sorted(r["id"] for r in P.extreme_rows(df, "v", "max").collect()) == [2, 4]
    assert [r["id"] for r in P.extreme_rows(df, "v", "min").collect()] == [1]
    words = spark.createDataFrame([("b",), ("a",)], "v string")
    assert P.extreme_rows(words, "v", "max").first()["v"] == "b"
    assert P.extreme_rows(frame(spark, [NAN, 1.0, None]), "x").first()["x"] == 1.0
    assert P.extreme_rows(frame(spark, [None, NAN]), "x").count() == 0
    with pytest.raises(ValueError):
        P.extreme_rows(words, "nope")


def test_basic_analysis_without_numbers(spark):
    assert P.basic_analysis(spark.createDataFrame([("a",)], "s string")).count() == 1


def expected(values, probabilities):
    return [float(np.quantile(np.array(values, dtype=float), p)) for p in probabilities]


SKEWED = [7.0] * 4000 + [float(i % 997) for i in range(4000)] + [1e9, -5.0, float(-(2**60))]


@pytest.mark.parametrize("values", [SKEWED, [5.0], [1.0, 2.0], [3.0] * 1000, [i / 7 for i in range(20000)]])
def test_percentile_plans_agree(spark, values):
    df = frame(spark, [*values, None, NAN])
    probabilities = [0.0, 0.06, 0.25, 0.5, 0.75, 1.0]
    wanted = pytest.approx(expected(values, probabilities), rel=1e-12)
    assert Q.percentiles(df, ["x"], probabilities).first()["q"] == wanted
    assert Q.percentiles(df, ["x"], probabilities, direct_rows=-1).first()["q"] == wanted
    grouped = df.withColumn("k", F.lit("one"))
    assert Q.percentiles(grouped, ["x"], probabilities, ("k",)).first()["q"] == wanted


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 1)), min_size=1, max_size=60))
def test_percentiles_of_any_values(spark, values):
    df = frame(spark, values)
    wanted = pytest.approx(expected(values, [0.25, 0.5]), rel=1e-9, abs=1e-9)
    assert Q.percentiles(df, ["x"], [0.25, 0.5], direct_rows=-1).first()["q"] == wanted
    assert Q.percentiles(df.withColumn("k", F.lit(1)), ["x"], [0.25, 0.5], ("k",)).first()["q"] == wanted


def test_grouped_percentiles_with_a_hot_group(spark):
    rows = [("hot", float(i % 50)) for i in range(3000)] + [("small", 1.0), ("small", 4.0), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    direct = {r["k"]: r["q"] for r in Q.percentiles(df, ["x"], [0.25, 0.5], ("k",), direct_rows=10**6).collect()}
    narrowed = {r["k"]: r["q"] for r in Q.percentiles(df, ["x"], [0.25, 0.5], ("k",), direct_rows=-1).collect()}
    assert direct == narrowed
    assert narrowed["small"] == [1.75, 2.5] and "empty" not in narrowed
    by_size = {}
    for limit in (None, -1):
        by_size[limit] = sorted(map(tuple, group_aggregate(df, ["k"], {"x": ["median", "count"]}, limit).collect()), key=str)
    assert [sorted(map(str, r)) for r in by_size[None]] == [sorted(map(str, r)) for r in by_size[-1]]
    assert summary(df, "x").first() == summary(df, "x", -1).first()


def test_describe_large_equals_direct(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    for keys in ((), ("l_returnflag",)):
        a = P.describe_numeric(df, ["l_quantity", "l_tax"], keys, digits=6)
        b = P.describe_numeric(df, ["l_quantity", "l_tax"], keys, digits=6, direct_rows=-1)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_plans_are_native_and_bounded(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    top = plan(P.top_values(orders))
    assert "WindowGroupLimit" in top and "partial_count" in top
    for df in (P.column_profile(orders), P.data_profile(orders, "o"), P.overview_hints(orders)):
        assert "Python" not in plan(df) and "CartesianProduct" not in plan(df) and "ArrowEval" not in plan(df)
    extreme = plan(P.extreme_rows(orders, "o_totalprice"))
    assert "Subquery" in extreme and "Join" not in extreme.split("== Physical Plan ==")[1]
    assert "ReadSchema: struct<o_totalprice:double>" in extreme
    duplicates = plan(P.duplicate_rows(spark.read.parquet(f"{sf}/documents.parquet").select("text")))
    assert "hashpartitioning(digest" in duplicates


def test_iqr(spark):
    row = P.iqr_outliers(frame(spark, [*map(float, range(100)), 1000.0, NAN])).first()
    assert row["outliers"] == 1 and math.isclose(row["upper"], 150.0)


def test_hints(spark):
    found = {r["hint"]: (r["column"], r["value"]) for r in P.overview_hints(spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "s string, x int")).collect()}
    assert found == {"duplicate_rows": (None, 1), "most_missing": ("x", 2), "numeric_follow_ups": (None, 1), "category_follow_ups": (None, 1)}


def test_sampled_brackets_are_exact(spark, monkeypatch):
    monkeypatch.setattr(Q, "SKETCH_SAMPLE", 2000)
    values = [float((i * 7919) % 30011) for i in range(40000)]
    df = spark.createDataFrame([(v, None if i else 3.0, None) for i, v in enumerate(values)], "x double, rare double, e double")
    found = {r["column"]: r["q"] for r in Q.percentiles(df, ["x", "rare", "e"], [0.0, 0.25, 0.5, 1.0], direct_rows=-1).collect()}
    assert found == {"x": expected(values, [0.0, 0.25, 0.5, 1.0]), "rare": [3.0] * 4}


def test_wide_brackets_are_narrowed_again(spark, monkeypatch):
    monkeypatch.setattr(Q, "SKETCH_SAMPLE", 2000)
    monkeypatch.setattr(Q, "ACCURACY", 50)
    monkeypatch.setattr(Q, "INSIDE_ROWS", 300)
    values = [float((i * 7919) % 30011) for i in range(40000)] + [15000.0] * 20000
    df = frame(spark, values)
    rounds = []
    narrower = Q._narrower
    monkeypatch.setattr(Q, "_narrower", lambda *a: rounds.append(1) or narrower(*a))
    found = Q._bracketed(df, ["x"], [0.1, 0.25, 0.5, 0.9])
    assert rounds and found.first()["q"] == expected(values, [0.1, 0.25, 0.5, 0.9])


def test_brackets_decide_large_columns(spark):
    df = frame(spark, [float(i % 9973) for i in range(30000)])
    assert Q._bracketed(df, ["x"], [0.25, 0.5]).first()["q"] == expected([i % 9973 for i in range(30000)], [0.25, 0.5])


def test_empty_and_wide_columns(spark):
    from decimal import Decimal

    empty = spark.createDataFrame([(None, 1.0), (None, 2.0)], "e double, x double")
    assert [tuple(r) for r in P.iqr_outliers(empty, ["e"]).collect()] == [(0, "e", None, None, 0)]
    assert P.iqr_outliers(empty, []).collect() == [] and P.describe_categorical(empty).collect() == []
    wide = spark.createDataFrame([(Decimal(10) ** 36, "a"), (Decimal(10) ** 36, "b"), (None, "a")], "d decimal(38,0), s string")
    assert {r["column"]: r["distinct"] for r in P.distinct_by_column(wide).collect()} == {"d": 1, "s": 2}


def test_top_values_of_long_texts(spark):
    start = "x" * 70
    rows = [(start + "b",)] * 3 + [(start + "a",)] * 3 + [("short",)] * 3 + [(start + "c",)] * 5 + [(None,)]
    top = P.top_values(spark.createDataFrame(rows, "t string"), 3).orderBy("rank").collect()
    assert (top[0]["value"], top[0]["n"], top[1]["value"]) == (start + "c", 5, "short")
    assert top[2]["value"] in (start + "a", start + "b") and len(top) == 3
    frequencies = plan(P.text_frequencies(spark.createDataFrame(rows, "t string"), ["t"]))
    assert "sha2" in frequencies


def test_grouped_percentiles_with_one_value_in_a_third(spark, monkeypatch):
    df = spark.range(9000).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 'hot' ELSE CAST(id % 5 AS STRING) END AS k", "CASE WHEN id % 9 < 3 THEN 7.0D ELSE CAST(id AS DOUBLE) END AS x"
    )
    exact = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("x", [0.2, 0.3, 0.9]).alias("q")).collect()}
    for most in (10**6, 0):
        monkeypatch.setattr(Q, "BROADCAST_BRACKETS", most)
        got = {r["k"]: r["q"] for r in Q.percentiles(df, ["x"], [0.2, 0.3, 0.9], ("k",)).collect()}
        assert got == {k: pytest.approx(v) for k, v in exact.items()}


def test_grouped_percentiles_of_all_sizes(spark):
    """Groups of one to many thousand values, several columns and keys, one group with a third of all rows, values that repeat, infinities."""
    df = spark.range(90_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 1 + id % 7 ELSE 100 + CAST(log2(1 + id % 30000) * 40 AS BIGINT) END AS v_0", "CAST(id % 2 AS STRING) AS k",
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN DOUBLE('inf') ELSE (id * 7919 % 30011) / 7 END AS x", "id % 50 AS y", "CASE WHEN id < 10 THEN id END AS rare",
    )
    probabilities = [0.0, 0.01, 0.5, 0.77, 1.0]
    exact = df.groupBy("v_0", "k").agg(*[F.percentile(c, probabilities).alias(c) for c in ("x", "y", "rare")])
    want = {(r["v_0"], r["k"], c): r[c] for r in exact.collect() for c in ("x", "y", "rare") if r[c] is not None}
    got = {(r["v_0"], r["k"], r["column"]): r["q"] for r in Q.percentiles(df, ["x", "y", "rare"], probabilities, ("v_0", "k")).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], nan_ok=True) for g in got)


def test_sample_rows(spark):
    df = spark.range(20).selectExpr("id", "CASE WHEN id = 1 THEN NULL ELSE 'v' || id END AS t")
    cells = {(r["row"], r["ordinal"]): r["text"] for r in P.sample_rows(df, ["id"]).collect()}
    assert len(cells) == 16 and cells[1, 0] == "0" and cells[2, 1] is None and cells[8, 1] == "v7"


def test_profile_states_merge(spark, sf, tmp_path):
    """States of partitions give what a full run gives; a new partition reads only itself."""
    from tabulon.operators import profile_states as S

    df = spark.read.parquet(f"{sf}/lineitem.parquet").withColumns(
        {"q": F.expr("CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN double('NaN') ELSE l_quantity END"), "empty": F.lit(None).cast("double")}
    )
    path = str(tmp_path / "states")
    parts = {str(i): df.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(4)) == i) for i in range(4)}
    for name, part in parts.items():
        S.add_partition(part, path, name)
    S.add_partition(parts["1"].limit(0), path, "none")
    S.add_partition(parts["2"].limit(3), path, "3")  # replaced below
    S.add_partition(parts["3"], path, "3")
    merged = S.merged(spark, path)
    assert "lineitem" not in plan(merged)
    got = {r["column"]: r for r in merged.collect()}
    wanted = {r["column"]: r for r in P.describe_numeric(df).collect()}
    profile = {r["column"]: r for r in P.column_profile(df).collect()}
    n = df.count()
    assert set(got) == set(df.columns)
    for name, r in got.items():
        assert (r["ordinal"], r["type"], r["rows"], r["missing"]) == (profile[name]["ordinal"], profile[name]["type"], n, profile[name]["missing"])
        assert r["distinct"] == pytest.approx(profile[name]["distinct"], rel=0.04)
        if name in wanted and wanted[name]["count"]:
            w = wanted[name]
            assert (r["count"], r["min"], r["max"]) == (w["count"], w["min"], w["max"])
            assert r["mean"] == pytest.approx(w["mean"], rel=1e-12) and r["std"] == pytest.approx(w["std"], rel=1e-9)
            for p in (25, 50, 75):
                below = df.where(F.col(name) < r[f"p{p}"]).count() / w["count"]
                upto = df.where(F.col(name) <= r[f"p{p}"]).where(~F.isnan(F.col(name).cast("double"))).count() / w["count"]
                assert below - 0.003 <= p / 100 <= upto + 0.003
        else:
            assert r["count"] in (None, 0) and r["mean"] is None and r["p50"] is None
    S.remove_partition(spark, path, "0")
    S.add_partition(spark.createDataFrame([(1, "new")], "l_orderkey long, other string"), path, "4")
    later = {r["column"]: r for r in S.merged(spark, path).collect()}
    left = n - parts["0"].count()
    assert later["l_tax"]["rows"] == left + 1 and later["l_tax"]["missing"] == 1 and later["other"]["missing"] == left and later["l_tax"]["count"] == left
    assert S.merged(spark, str(tmp_path / "nothing")).collect() == []
