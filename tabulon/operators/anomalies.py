"""Isolation Forest: samples of the whole table, trees built in parallel, Arrow scoring, exact cut."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import col
from tabulon.operators.quantiles import percentile_values

# Model defaults.
SEED = 42
TREES = 100
SAMPLE_ROWS = 256
EULER = 0.5772156649
MIN_CONTAMINATION, MAX_CONTAMINATION, DEFAULT_CONTAMINATION = 0.01, 0.5, 0.06

SPARE = 64  # rows drawn for a tree beyond twice its sample, so that it never falls short


def average_path(n):
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


@dataclass(frozen=True)
class Forest:
    """Full binary trees in heap order; a finished branch repeats its value down to the last level."""

    features: list[str]
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    path: np.ndarray  # trees x last-level leaves
    depth: int
    sample_rows: int


def _grow(rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros(inner, dtype=np.int32)
    threshold = np.full(inner, np.inf)
    path = np.zeros(leaves)
    todo = [(0, 0, rows)]
    while todo:
        node, level, part = todo.pop()
        spread = part.max(0) - part.min(0) if len(part) > 1 else np.zeros(rows.shape[1])
        if level < depth and (spread > 0).any():
            chosen = rng.choice(np.flatnonzero(spread > 0))
            low = part[:, chosen].min()
            cut = rng.uniform(low, low + spread[chosen])
            left = part[:, chosen] <= cut
            feature[node], threshold[node] = chosen, cut
            todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
        else:
            first = (node + 1) * 2 ** (depth - level) - 1 - inner
            path[first : first + 2 ** (depth - level)] = level + average_path(len(part))
    return feature, threshold, path


def _samples(df: DataFrame, features: list[str], trees: int, sample: int, rows: int, seed: int, key: list[str] | None) -> DataFrame:
    """``(tree, draw, features…)``: for every tree some more than ``sample`` rows, drawn from the whole table in one scan.

    Draws depend on ``seed``, the tree and the row's ``key`` alone; without a key on its values, and equal rows are
    counted first, so that each of them has its own draw. How the table is partitioned does not matter.
    """
    values = [col(f).cast("double").alias(f) for f in features]
    if key:
        counted = df.select(F.xxhash64(F.lit(seed), *[col(k) for k in key]).alias("id"), F.lit(1).cast("bigint").alias("copies"), *values)
    else:
        counted = df.select(*values).groupBy(*features).agg(F.count(F.lit(1)).alias("copies"))
        counted = counted.select(F.xxhash64(F.lit(seed), *features).alias("id"), "copies", *features)
    share = min(1.0, (2.0 * sample + SPARE) / rows)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(trees, dtype=np.uint64)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False).view(np.uint64)
            copies = batch.column("copies").to_numpy(zero_copy_only=False)
            single = np.flatnonzero(copies == 1)
            chance = _uniform(ids[single][:, None] ^ _spread(numbers + np.uint64(1))[None, :])
            at, tree = np.nonzero(chance < share)
            rows_at, trees_at, draws = [single[at]], [tree], [chance[at, tree]]
            for i in np.flatnonzero(copies > 1).tolist():
                rng = np.random.Generator(np.random.Philox(int(ids[i])))
                many = rng.binomial(int(copies[i]), share, trees)
                rows_at.append(np.full(many.sum(), i))
                trees_at.append(np.repeat(np.arange(trees), many))
                draws.append(rng.random(int(many.sum())) * share)
            chosen = pa.array(np.concatenate(rows_at))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(trees_at).astype(np.int32)),
                    pa.array(np.concatenate(draws).astype(float)),
                    *(batch.column(f).take(chosen) for f in features),
                ],
                ["tree", "draw", *features],
            )

    fields = ", ".join(f"`{f}` double" for f in features)
    return counted.mapInArrow(draw, f"tree int, draw double, {fields}")


def _spread(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (_spread(h) >> np.uint64(11)).astype(float) / 2.0**53


def fit_forest(
    df: DataFrame,
    features: list[str],
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = SEED,
    key: list[str] | None = None,
) -> Forest:
    """Trees grow in parallel Spark tasks from 256-row samples of the whole table; the driver receives the cut
    points only (at most trees x 511 numbers). The forest does not depend on how the table is partitioned."""
    size = df.count()
    if size == 0:
        raise ValueError("no rows to learn from")
    sample = min(sample_rows, size)
    depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
    drawn = _samples(df, features, trees, sample, size, seed, key)
    partitions = max(1, min(trees, df.sparkSession.sparkContext.defaultParallelism))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        rows = group.sort_values(["draw", *features]).head(sample)[features].to_numpy(dtype=float)
        feature, threshold, path = _grow(rows, depth, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "feature": [feature.tolist()], "threshold": [threshold.tolist()], "path": [path.tolist()]})

    grown = drawn.repartition(partitions, "tree").groupBy("tree").applyInPandas(
        grow, "tree int, feature array<int>, threshold array<double>, path array<double>"
    )
    nodes = sorted(grown.collect(), key=lambda r: r["tree"])
    return Forest(
        features,
        np.array([r["feature"] for r in nodes], dtype=np.int32),
        np.array([r["threshold"] for r in nodes]),
        np.array([r["path"] for r in nodes]),
        depth,
        sample,
    )


def score_rows(df: DataFrame, forest: Forest, score: str = "score") -> DataFrame:
    """Append ``-2^(-mean path / c(sample))``: near -1 for rows that are cut off early.

    Only the feature columns travel to Python (Arrow batches); the other columns stay put.
    """
    scale = max(float(average_path(forest.sample_rows)), 1e-12)
    depth = forest.depth
    shared = df.sparkSession.sparkContext.broadcast((forest.feature, forest.threshold, forest.path))

    @F.pandas_udf("double")
    def depth_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        features, thresholds, paths = shared.value
        inner = features.shape[1]
        for columns in batches:
            series = columns if isinstance(columns, tuple) else (columns,)
            rows = np.column_stack([c.to_numpy(dtype=float) for c in series])
            flat, base = rows.ravel(), np.arange(len(rows)) * rows.shape[1]
            total = np.zeros(len(rows))
            for feature, threshold, path in zip(features, thresholds, paths):
                node = np.zeros(len(rows), dtype=np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (flat[base + feature[node]] > threshold[node])
                total += path[node - inner]
            yield pd.Series(-np.exp2(-(total / len(paths)) / scale))

    return df.withColumn(score, depth_score(*[col(f).cast("double") for f in forest.features]))


def contamination_cut(df: DataFrame, score: str, contamination: float = DEFAULT_CONTAMINATION, direct_rows: int | None = None) -> DataFrame:
    """Append ``anomaly_score`` (score less the cut), ``anomaly_prediction`` and ``is_anomaly``.

    The cut is the exact linear percentile of ``score`` at ``contamination``; only scores strictly
    below it are anomalies. Works on any score column, lowest = most unusual.
    """
    if not 0 < contamination <= MAX_CONTAMINATION:
        raise ValueError(f"contamination must be above 0 and at most {MAX_CONTAMINATION}")
    offset = percentile_values(df, [score], contamination, direct_rows).get(score)
    relative = col(score) - F.lit(offset)
    return df.withColumns(
        {
            "anomaly_prediction": F.when(relative < 0, F.lit(-1)).otherwise(F.lit(1)),
            "is_anomaly": relative < 0,
            "anomaly_score": relative,
        }
    )
