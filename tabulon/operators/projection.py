"""Two-dimensional views of feature columns."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import col


def principal_axes(df: DataFrame, features: list[str]) -> tuple[np.ndarray, list[float]]:
    """Loadings (features x 2) and explained-variance shares. The sign of each axis is fixed so
    that its largest loading is positive."""
    vectors = VectorAssembler(inputCols=features, outputCol="v").transform(df.select(*[col(f).alias(f) for f in features]))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(vectors.select("v"))
    axes = np.array(model.pc.toArray())
    for j in range(axes.shape[1]):
        if axes[np.abs(axes[:, j]).argmax(), j] < 0:
            axes[:, j] = -axes[:, j]
    return axes, [float(x) for x in model.explainedVariance]


def project_2d(df: DataFrame, features: list[str]) -> tuple[DataFrame, float]:
    """``df`` plus ``x`` and ``y``, and the share of variance they explain.

    Up to two features are used as they are (one feature gives ``y = 0``). The projection is a
    native expression; features are expected to be centred.
    """
    if len(features) <= 2:
        y = col(features[1]) if len(features) == 2 else F.lit(0.0)
        return df.withColumns({"x": col(features[0]), "y": y}), 1.0
    axes, shares = principal_axes(df, features)
    axis = [sum((col(f) * F.lit(float(axes[i, j])) for i, f in enumerate(features)), F.lit(0.0)) for j in (0, 1)]
    return df.withColumns({"x": axis[0], "y": axis[1]}), sum(shares)


def plot_frame(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``(x, y, label)`` for a scatter plot of clusters or anomalies."""
    return project_2d(df, features)[0].select("x", "y", col(label).alias("label"))
