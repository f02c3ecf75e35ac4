import numpy as np
import pytest

from tabulon.operators import anomalies as A
from tabulon.operators import clustering as K
from tabulon.operators import features as X
from tabulon.operators import projection as Pj
from tabulon.plans import models


@pytest.fixture(scope="module")
def groups(spark):
    """Three well separated groups of 60, 40 and 20 points."""
    rows = [(g, i, c[0] + (i % 7) / 7, c[1] + (i % 5) / 5, float(i % 3)) for g, (n, c) in enumerate([(60, (0, 0)), (40, (50, 0)), (20, (0, 80))]) for i in range(n)]
    return spark.createDataFrame(rows, "g int, i int, a double, b double, c double")


def silhouette(points, labels):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == x].mean() for x in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_cleaning_and_guards(spark):
    df = spark.createDataFrame([(1.0, None, "t"), (float("inf"), float("nan"), "u")], "x double, e double, s string")
    cleaned, kept = X.clean_features(df, ["x", "e"])
    assert kept == ["x"] and sorted([r["x"] for r in cleaned.collect()], key=str) == [1.0, None]
    with pytest.raises(ValueError):
        X.clean_features(df, ["e"])
    with pytest.raises(ValueError):
        X.clean_features(df, ["s"])
    with pytest.raises(ValueError):
        models.cluster(df, ["x"])


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (4.0, 5.0), (None, 5.0), (20.0, None)], "x double, k double")
    assert sorted(r["x"] for r in X.impute_median(df, ["x"]).collect()) == [1.0, 4.0, 4.0, 20.0]
    wide, features, sources = X.prepared(df, ["x", "k"])
    values = np.array([[r[f] for f in features] for r in wide.collect()])
    assert sources == ["x", "k"] and np.allclose(values[:, 1], 0) and np.allclose(values[:, 0].std(), 1)


def test_kmeans_finds_the_groups(groups):
    model = K.fit_kmeans(groups, ["a", "b"], 3)
    assert model.sizes == [60, 40, 20] and model.cost <= min(model.costs) + 1e-9
    rows = K.assign_clusters(groups, ["a", "b"], model.centers).collect()
    assert all(r["g"] == r["cluster"] for r in rows)
    points = np.array([[r["a"], r["b"]] for r in rows])
    distance = ((points[:, None] - model.centers[None]) ** 2).sum(-1)
    assert (distance.argmin(1) == [r["cluster"] for r in rows]).all()
    assert model.cost == pytest.approx(distance.min(1).sum())
    again = K.fit_kmeans(groups, ["a", "b"], 3)
    assert np.allclose(model.centers, again.centers)


def test_kmeans_does_not_depend_on_partitions(groups):
    one, many = (K.fit_kmeans(groups.repartition(n), ["a", "b"], 3, starts=2) for n in (1, 7))
    assert np.allclose(one.centers, many.centers) and one.sizes == many.sizes


def test_kmeans_empty_centers_move(spark, groups):
    start = [[0.0, 0.0], [1e6, 1e6], [2e6, 2e6]]
    assert min(K.fit_kmeans(groups, ["a", "b"], 3, initial=start).sizes) > 0
    two = spark.createDataFrame([(0.0, 0.0), (5.0, 5.0)] * 500, "a double, b double")
    assert sorted(K.fit_kmeans(two, ["a", "b"], 4, starts=2).sizes) == [0, 0, 500, 500]


def test_kmeans_from_given_centers(groups):
    start = np.array([[0.0, 0.0], [3.0, 1.0], [4.0, 70.0]])
    model = K.fit_kmeans(groups, ["a", "b"], 3, initial=start, max_iterations=2, tolerance=-1.0)
    points = np.array([[r["a"], r["b"]] for r in groups.collect()])
    for _ in range(2):
        nearest = ((points[:, None] - start[None]) ** 2).sum(-1).argmin(1)
        start = np.array([points[nearest == c].mean(0) for c in range(3)])
    assert np.allclose(sorted(map(tuple, model.centers)), sorted(map(tuple, start)))


def test_kmeans_guards(groups):
    for k in (1, 13):
        with pytest.raises(ValueError):
            K.fit_kmeans(groups, ["a", "b"], k)
    with pytest.raises(ValueError):
        K.fit_kmeans(groups.limit(2), ["a", "b"], 3)


def test_sums_by_spark_and_by_the_driver_agree(spark, groups, monkeypatch):
    one = K.fit_kmeans(groups.repartition(5), ["a", "b"], 3)
    monkeypatch.setattr(K, "DIRECT_TASKS", 0)
    other = K.fit_kmeans(groups.repartition(3), ["a", "b"], 3)
    assert one.sizes == other.sizes and one.iterations == other.iterations
    assert one.centers == pytest.approx(other.centers) and one.costs == pytest.approx(other.costs)


def test_least_keys_need_few_logarithms():
    """Keys come out exactly as if all were computed, but only for rows that can be below the bound."""
    rng = np.random.default_rng(3)
    rows, weight = rng.normal(size=(5000, 3)), np.r_[np.zeros(10), rng.exponential(size=4990)]
    draws = K._draws(rows, 11)
    assert draws.min() > 0 and draws.max() < 1 and (draws == K._draws(rows[::-1], 11)[::-1]).all()
    usable = weight > 1e-12
    every = -np.log(draws[usable]) / weight[usable]
    for below in (np.inf, 0.01, 0.0):
        key, points = K._least_keys(rows, weight, 11, below)
        assert (key == every[every < below]).all() and (points == rows[usable][every < below]).all()


def test_kmeans_scans_in_slices_and_small_batches(spark):
    rng = np.random.default_rng(4)
    points = np.r_[rng.normal(size=(2 * K.SLICE_ROWS + 5, 2)), [[0.5, 0.0]] * 3]
    data = spark.createDataFrame(points.tolist(), "a double, b double")
    blocks = K._blocks(data, ["a", "b"])
    centers = {0: np.array([[0.0, 0.0], [1.0, 0.0], [9.0, 9.0]]), 2: rng.normal(size=(3, 2))}
    got, counts = K._scan(blocks, ["a", "b"], centers, with_cost=True), K._scan(blocks, ["a", "b"], centers, counts_only=True)
    for start, near in centers.items():
        apart = ((points[:, None] - near[None]) ** 2).sum(-1)
        label = apart.argmin(1)  # the lowest number wins ties
        assert got[start][0].tolist() == counts[start][0].tolist() == np.bincount(label, minlength=3).tolist()
        assert np.allclose(got[start][1], [points[label == c].sum(0) for c in range(3)])
        assert np.allclose(got[start][2], [apart[label == c, c].sum() for c in range(3)])
    assert not counts[0][1].any()


def test_silhouette_in_one_and_many_blocks(spark, groups, monkeypatch):
    extra = spark.createDataFrame([(9, 0, 200.0, 200.0, 0.0)], groups.schema)  # a cluster of one row
    df = groups.unionByName(extra)
    rows = df.collect()
    points, labels = np.array([[r["a"], r["b"], r["c"]] for r in rows]), np.array([r["g"] for r in rows])
    wanted = sorted(silhouette(points, labels))
    named = df.withColumn("g", df["g"].cast("string"))  # labels of any type
    for size, frame in ((1024, df), (17, df), (50, named.repartition(3))):
        monkeypatch.setattr(K, "BLOCK_ROWS", size)
        found = sorted(r["silhouette"] for r in K.silhouette_rows(frame, ["a", "b", "c"], "g").collect())
        assert found == pytest.approx(wanted, abs=1e-6)
    assert K.silhouette(df, ["a", "b", "c"], "g", metric="euclidean") == pytest.approx(np.mean(wanted), abs=1e-6)
    assert K.silhouette(df, ["a", "b", "c"], "g") == K.silhouette_squared(df, ["a", "b", "c"], "g")
    with pytest.raises(ValueError):
        K.silhouette(df, ["a"], "g", metric="other")


def test_silhouette_leaves_out_far_clusters(spark, monkeypatch, capsys):
    """Twelve clusters along a line: most blocks need not meet, the result is that of all pairs."""
    monkeypatch.setattr(K, "BLOCK_ROWS", 16)
    monkeypatch.setattr(K, "GROUP_BLOCKS", 2)
    rng = np.random.default_rng(1)
    labels = [str(i % 12) for i in range(600)] + ["alone"]
    points = np.array([[10.0 * (i % 12), 0.0] for i in range(600)] + [[500.0, 1.0]]) + rng.normal(size=(601, 2))
    df = spark.createDataFrame([(*map(float, p), g) for p, g in zip(points, labels, strict=True)], "a double, b double, g string")
    compared, every = K.silhouette_blocks(df, ["a", "b"], "g").pairs()
    print(f"compared {compared} of {every} pairs of blocks")
    assert 0 < compared < every / 2
    found = sorted(r["silhouette"] for r in K.silhouette_rows(df, ["a", "b"], "g").collect())
    assert found == pytest.approx(sorted(silhouette(points, np.array(labels))), abs=1e-6)
    for most in (0, 10**6):
        monkeypatch.setattr(K, "BROADCAST_NEEDED", most)
        assert sorted(r["silhouette"] for r in K.silhouette_rows(df, ["a", "b"], "g").collect()) == pytest.approx(found)


def test_silhouette_bounds_hold():
    """No cluster that is the nearest by its mean distance is ever left out, clusters of any shape."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        k = int(rng.integers(2, 12))
        points = np.concatenate([rng.normal(rng.normal(0, 5, 3), rng.uniform(0, 4), (int(rng.integers(1, 40)), 3)) for _ in range(k)])
        own = rng.integers(0, k, len(points)) if rng.random() < 0.5 else np.arange(len(points)) % k
        own[:k] = np.arange(k)
        centers = np.array([points[own == c].mean(axis=0) for c in range(k)])
        spread = np.array([((points[own == c] - centers[c]) ** 2).sum(axis=1).mean() for c in range(k)])
        mean = np.stack([np.linalg.norm(points[:, None] - points[own == c][None], axis=2).mean(axis=1) for c in range(k)], axis=1)
        mean[np.arange(len(points)), own] = np.inf
        assert K._candidates(points, own, centers, spread)[np.arange(len(points)), mean.argmin(axis=1)].all()


def test_silhouette_needs_labels(groups):
    single = groups.where("g = 2").limit(4)
    for df in (groups.where("g = 0"), single.withColumn("g", single["i"]), groups.limit(0)):
        assert K.silhouette_rows(df, ["a", "b"], "g").collect() == []
        assert K.silhouette(df, ["a", "b"], "g") is None and K.silhouette(df, ["a", "b"], "g", metric="euclidean") is None


def test_cluster_report(groups):
    report = models.cluster(groups, ["a", "b", "c"], 3)
    assert [r["n"] for r in report.sizes.collect()] == [60, 40, 20]
    assert set(report.rows.columns) == {*groups.columns, "cluster"}
    assert set(report.profile.columns) == {"cluster", "a", "b", "c"} and 0.4 < report.silhouette <= 1
    assert report.points.count() == 120 and 0 < report.explained <= 1.0001


def test_projection(groups):
    axes, shares = Pj.principal_axes(X.standardize(groups, ["a", "b", "c"]), ["a", "b", "c"])
    assert np.allclose(axes.T @ axes, np.eye(2)) and shares[0] >= shares[1]
    values = np.array([[r["a"], r["b"], r["c"]] for r in X.standardize(groups, ["a", "b", "c"]).collect()])
    eigen = np.sort(np.linalg.eigvalsh(np.cov(values.T)))[::-1]
    assert shares == pytest.approx(list(eigen[:2] / eigen.sum()))
    assert all(axes[np.abs(axes[:, j]).argmax(), j] > 0 for j in (0, 1))
    one = Pj.plot_frame(groups, ["a"], "g")
    assert one.where("y <> 0").count() == 0 and one.columns == ["x", "y", "label"]


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(i, float(i % 25), float(i % 20)) for i in range(500)] + [(500 + j, 400.0 + 90 * j, -300.0 - 70 * j) for j in range(5)]
    return spark.createDataFrame(rows, "id int, x double, y double")


def test_path_lengths():
    assert A.average_path(1) == 0 and A.average_path(2) == 1
    assert A.average_path(256) == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_forest_ranks_planted_rows_lowest(planted):
    forest = A.fit_forest(planted, ["x", "y"])
    assert forest.feature.shape == (100, 255) and forest.depth == 8
    scored = A.score_rows(planted, forest).orderBy("score").collect()
    assert {r["id"] for r in scored[:5]} == set(range(500, 505))
    assert all(-1 <= r["score"] < 0 for r in scored)
    again = A.score_rows(planted, A.fit_forest(planted, ["x", "y"])).orderBy("score").collect()
    assert [r["score"] for r in scored] == [r["score"] for r in again]


def same(one, other):
    return all(np.array_equal(getattr(one, n), getattr(other, n)) for n in ("feature", "threshold", "path"))


@pytest.mark.parametrize("rows", [300, 70_000])
def test_forest_does_not_depend_on_files(spark, rows, tmp_path):
    """Below and above the size at which samples were once drawn from a part of the table."""
    df = spark.range(rows).selectExpr("id", "CAST(id % 251 AS DOUBLE) AS x", "CAST(hash(id) % 1000 AS DOUBLE) AS y")
    for n in (1, 6):
        df.repartition(n).write.parquet(str(tmp_path / str(n)))
    files = [spark.read.parquet(str(tmp_path / str(n))) for n in (1, 6)]
    for key in (None, ["id"]):
        one, other = (A.fit_forest(f, ["x", "y"], trees=7, key=key) for f in files)
        assert same(one, other) and one.sample_rows == 256 if rows > 256 else True


def test_forest_of_many_equal_rows(spark):
    """A row that is half of the table is half of a sample, not all of it."""
    df = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 0.0D ELSE CAST(id AS DOUBLE) END AS x")
    drawn = A._samples(df, ["x"], 10, 256, 20_000, 1, None).groupBy("tree").agg({"*": "count", "x": "avg"}).collect()
    assert all(400 < r["count(1)"] < 800 for r in drawn) and all(3500 < r["avg(x)"] < 6500 for r in drawn)


def test_forest_of_identical_rows(spark):
    df = spark.range(300).selectExpr("1.0D AS x")
    assert A.score_rows(df, A.fit_forest(df, ["x"], trees=5)).select("score").distinct().count() == 1


def test_cut_is_strict(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 2, 3]], "s double")
    assert A.contamination_cut(df, "s", 0.5).where("is_anomaly").count() == 0
    cut = A.contamination_cut(df, "s", 0.5).first()
    assert set(cut.asDict()) == {"s", "anomaly_prediction", "is_anomaly", "anomaly_score"}
    with pytest.raises(ValueError):
        A.contamination_cut(df, "s", 0.6)


def test_anomaly_report(planted):
    report = models.anomalies(planted, ["x", "y"], 0.02)
    flagged = report.rows.where("is_anomaly")
    assert set(range(500, 505)) <= {r["id"] for r in report.anomalies.collect()}
    assert flagged.count() <= 0.02 * 505 and report.rows.where("is_anomaly <> (anomaly_prediction = -1)").count() == 0
    assert report.rows.columns == ["id", "x", "y", "anomaly_prediction", "is_anomaly", "anomaly_score"]
    assert report.points.columns == ["x", "y", "is_anomaly"]
