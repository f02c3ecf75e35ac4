import math

import pandas as pd
import pytest
from plan_texts import plan
from pyspark.sql import functions as F

from tabulon.operators import adhoc

NAN = float("nan")


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, NAN), ("b", 3.0, 6.0), (None, 4.0, 8.5), ("b", None, 1.0), ("b", NAN, 2.0)]
    return spark.createDataFrame(rows, "k string, x double, y double")


def test_groups_leave_out_missing_keys(numbers):
    rows = {r["k"]: r for r in adhoc.group_aggregate(numbers, ["k"], {"*": ["size"], "x": ["count", "sum", "median"]}).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["b"]["size"], rows["b"]["count_x"], rows["b"]["sum_x"], rows["b"]["median_x"]) == (3, 1, 3.0, 3.0)


def test_pivot(numbers):
    named = adhoc.pivot_table(numbers.withColumn("one", F.lit(1)), ["one"], "k", "x", "sum", ["a", "b"]).first()
    assert (named["a"], named["b"]) == (3.0, 3.0)
    assert set(adhoc.pivot_table(numbers.withColumn("one", F.lit(1)), ["one"], "k", "x").columns) == {"one", "a", "b"}


def test_correlation_uses_complete_pairs(numbers):
    pandas = numbers.toPandas()[["x", "y"]].corr()
    found = {(r["column_x"], r["column_y"]): r["correlation"] for r in adhoc.correlation_matrix(numbers).collect()}
    assert found[("x", "y")] == pytest.approx(pandas.loc["x", "y"])
    assert adhoc.correlation(numbers, "x", "y").first()[0] == pytest.approx(pandas.loc["x", "y"])


def test_regression(numbers):
    line = adhoc.regression_line(numbers, "x", "y").first()
    assert line["n"] == 3
    assert line["slope"] == pytest.approx(((1 - 8 / 3) * (2 - 5.5) + (3 - 8 / 3) * 0.5 + (4 - 8 / 3) * 3) / ((1 - 8 / 3) ** 2 + (3 - 8 / 3) ** 2 + (4 - 8 / 3) ** 2))


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 1, 10)], "v double")
    assert [r["n"] for r in adhoc.histogram(df, "v", 5).orderBy("bin").collect()] == [3, 0, 0, 0, 1]
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert sum(r["n"] for r in adhoc.histogram(same, "v").collect()) == 2
    assert adhoc.histogram(spark.createDataFrame([(NAN,)], "v double"), "v").count() == 0


def test_scatter_sample_is_stable(spark):
    df = spark.range(1000).selectExpr("id", "double(id) AS x", "double(-id) AS y")
    first = adhoc.scatter_points(df, "x", "y", 0.2, ["id"])
    again = adhoc.scatter_points(df.repartition(7), "x", "y", 0.2, ["id"])
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert 120 < first.count() < 280
    with pytest.raises(ValueError):
        adhoc.scatter_points(df, "x", "y", 0.2)


def test_user_functions(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id")
    by_group = adhoc.apply_by_group(df, ["k"], lambda g: pd.DataFrame({"k": [g["k"].iloc[0]], "s": [g["id"].sum()]}), "k long, s long")
    parts = adhoc.combine_by_group(df, ["k"], lambda b: b.groupby("k", as_index=False)["id"].sum().rename(columns={"id": "s"}), "k long, s long", [F.sum("s").alias("s")])
    assert sorted(map(tuple, by_group.collect())) == sorted(map(tuple, parts.collect()))
    with pytest.raises(ValueError):
        adhoc.apply_by_group(df, ["k"], lambda g: g, "k long, id long", max_rows=10)


def test_small_groups_are_many_tasks_work(spark):
    """Few bytes of many groups: the function's calls are dealt over the cores."""

    def where(group: pd.DataFrame) -> pd.DataFrame:
        from pyspark import TaskContext

        return pd.DataFrame({"k": [group["k"].iloc[0]], "n": [len(group)], "task": [TaskContext.get().partitionId()]})

    rows = adhoc.apply_by_group(spark.range(600).selectExpr("IF(id < 590, id % 200, NULL) AS k", "id"), ["k"], where, "k long, n long, task int").collect()
    assert sorted((r.k, r.n) for r in rows) == [(k, 3 if k < 190 else 2) for k in range(200)]
    assert len({r.task for r in rows}) >= spark.sparkContext.defaultParallelism


def test_steps(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    found = adhoc.analyze(
        df,
        [
            ("filter", "o_totalprice > 1000"),
            ("group", {"keys": ["o_orderstatus"], "aggregates": {"o_totalprice": ["mean", "max"]}}),
            ("sort", {"order": [("max_o_totalprice", "desc")], "limit": 1}),
        ],
    )
    assert found.count() == 1
    filtered = plan(adhoc.analyze(df, [("filter", "o_totalprice > 1000"), ("select", ["o_orderkey"])]))
    assert "GreaterThan(o_totalprice,1000.0)" in filtered and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in filtered
    with pytest.raises(ValueError):
        adhoc.analyze(df, [("explode", None)])
    assert not math.isnan(found.first()["mean_o_totalprice"])


def test_correlations_of_many_columns(spark, monkeypatch):
    """Pairs over the rows they have in common, with missing values, infinities, constants and large offsets; one scan for 500 columns."""
    import numpy as np

    from tabulon.operators import gram

    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 4))
    frame = pd.DataFrame({f"c{i}": base @ rng.normal(size=4) + rng.normal(size=400) + 1e6 * (i % 3) for i in range(24)})
    frame = frame.mask(rng.random(frame.shape) < 0.3)
    frame["constant"], frame["never"], frame["infinite"] = 5.0, NAN, frame["c1"].where(frame.index != 7, np.inf)
    frame["once"] = frame["c0"].where(frame.index == frame["c0"].first_valid_index())
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in frame.columns)).repartition(3)
    monkeypatch.setattr(gram, "ROWS", 64)
    got = {(r[0], r[1]): r[2] for r in adhoc.correlation_matrix(df).collect()}
    assert len(got) == len(frame.columns) ** 2
    plain = frame.corr(min_periods=2)
    for a in frame.columns:
        for b in frame.columns:
            both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
            if len(both) < 2:
                assert got[a, b] is None
            elif np.isinf(both.to_numpy()).any() or "constant" in (a, b):
                assert math.isnan(got[a, b])
            else:
                assert got[a, b] == pytest.approx(plain.loc[a, b], abs=1e-9)
    assert got["c3", "c3"] == 1.0 and got["c2", "c9"] == got["c9", "c2"]
    wide = spark.range(2000).select(*[(F.rand(i) + F.col("id") * (i % 2)).alias(f"w{i}") for i in range(500)])
    found = adhoc.correlation_matrix(wide)
    assert plan(found).split("== Physical Plan ==")[1].count("MapInArrow") <= 2 and found.count() == 250_000  # read once for either half
    empty = adhoc.correlation_matrix(df.where("false"))
    assert {r[2] for r in empty.collect()} == {None}


def test_groups_as_streams(spark):
    """Groups that are far larger than a frame: only sums are kept, some groups are read in part."""
    df = spark.range(200_000).selectExpr("CASE WHEN id % 3 < 2 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE 'k' || id % 5 END AS k", "id % 2 AS m", "id AS x")
    sizes = []

    def last_and_sum(key, frames):
        total, last, most = 0, None, 0
        for f in frames:
            assert last is None or f["x"].iloc[0] > last
            total, last, most = total + int(f["x"].sum()), int(f["x"].iloc[-1]), max(most, len(f))
            if key[0] == "k3":
                break
        yield pd.DataFrame({"k": [key[0]], "m": [key[1]], "total": [total], "last": [last], "most": [most]})

    schema = "k string, m long, total long, last long, most long"
    rows = {(r.k, r.m): r for r in adhoc.stream_by_group(df, ["k", "m"], last_and_sum, schema, order=["x"]).collect()}
    want = {(r.k, r.m): r for r in df.where("k IS NOT NULL").groupBy("k", "m").agg(F.sum("x").alias("total"), F.max("x").alias("last")).collect()}
    assert set(rows) == set(want) and sizes == []
    assert all((rows[g].total, rows[g].last) == (want[g].total, want[g].last) for g in rows if g[0] != "k3")
    assert max(r.most for r in rows.values()) <= 10_000 < df.where("k = 'hot' AND m = 0").count() / 6
    assert adhoc.stream_by_group(df.where("false"), ["k"], last_and_sum, schema).collect() == []


def test_many_columns_in_prompts(spark):
    """The automaton finds the same first column as the expression for few columns."""
    import random

    from tabulon.functions import questions

    rng = random.Random(2)
    parts = ["year", "Of", "study", "a", "price", "preis", "x-1", "net amount", "id", "_", ""]
    names = list(dict.fromkeys("".join(rng.choice(parts) + rng.choice(["", "_", " "]) for _ in range(rng.randrange(1, 4))) for _ in range(80)))
    prompts = [" ".join(rng.choice(["Zeile", "mit", "`Year of_study`", "PRICE", '"net-amount"', "höchsten", "x 1", "nothing", "id"]) for _ in range(rng.randrange(6))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(prompts)), "i int, p string")
    for columns in (names, [n for n in names if n.strip("_ ")], ["zzz"]):
        few = {r.i: r.named for r in questions.routed(df, "p", columns[:100]).collect()}
        old = questions.MANY_COLUMNS
        try:
            questions.MANY_COLUMNS = 0
            assert {r.i: r.named for r in questions.routed(df, "p", columns[:100]).collect()} == few
        finally:
            questions.MANY_COLUMNS = old
    many = [f"column {i}" for i in range(5000)] + ["price"]
    found = {r.i: r.named for r in questions.routed(spark.createDataFrame([(0, "the price"), (1, "Column_4321 alone"), (2, "none")], "i int, p string"), "p", many).collect()}
    assert found == {0: "price", 1: "column 4", 2: None}

