"""The two model reports: clusters and anomalies of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tabulon.functions.columns import require_columns
from tabulon.operators.anomalies import DEFAULT_CONTAMINATION, contamination_cut, fit_forest, score_rows
from tabulon.operators.clustering import (
    DEFAULT_CLUSTERS,
    KMeansModel,
    assign_clusters,
    cluster_profile,
    cluster_sizes,
    fit_kmeans,
    SILHOUETTE_METRIC,
    silhouette,
)
from tabulon.operators.features import default_features, prepared
from tabulon.operators.projection import project_2d
from tabulon.session import staged


@dataclass(frozen=True)
class ClusterReport:
    rows: DataFrame  # all original columns plus ``cluster``
    sizes: DataFrame
    profile: DataFrame
    silhouette: float | None
    silhouette_metric: str
    points: DataFrame  # x, y, cluster
    explained: float
    model: KMeansModel


def cluster(
    df: DataFrame, columns: list[str] | None = None, k: int = DEFAULT_CLUSTERS, starts: int = 10, metric: str = SILHOUETTE_METRIC, **options
) -> ClusterReport:
    """Clean, impute, scale, group by K-Means and describe the groups.

    ``metric`` is the one of the silhouette; ``options`` go to ``fit_kmeans``.
    """
    columns = default_features(df) if columns is None else columns
    require_columns(df, columns, at_least=2, numeric=True)
    wide, features, sources = prepared(df, columns)
    model = fit_kmeans(wide, features, k, starts, **options)
    labelled = assign_clusters(wide, features, model.centers)
    score = silhouette(labelled, features, metric=metric)
    points, explained = project_2d(labelled, features)
    rows = labelled.drop(*features)
    return ClusterReport(
        rows=rows,
        sizes=cluster_sizes(rows),
        profile=cluster_profile(rows, sources),
        silhouette=None if score is None else round(score, 3),
        silhouette_metric=metric,
        points=points.select("x", "y", "cluster"),
        explained=explained,
        model=model,
    )


@dataclass(frozen=True)
class AnomalyReport:
    rows: DataFrame  # all original columns plus anomaly_prediction, is_anomaly, anomaly_score
    anomalies: DataFrame
    points: DataFrame  # x, y, is_anomaly
    explained: float


def anomalies(
    df: DataFrame,
    columns: list[str] | None = None,
    contamination: float = DEFAULT_CONTAMINATION,
    key: list[str] | None = None,
) -> AnomalyReport:
    """Clean, impute, scale, score by an Isolation Forest and cut at the contamination share.

    Scored rows are written once: the cut needs all scores, and scoring is the costly part.
    """
    columns = default_features(df) if columns is None else columns
    require_columns(df, columns, at_least=1, numeric=True)
    wide, features, _ = prepared(df, columns)
    forest = fit_forest(wide, features, key=key)
    scored = staged(score_rows(wide, forest), "scored-rows")
    flagged = contamination_cut(scored, "score", contamination)
    points, explained = project_2d(flagged, features)
    rows = flagged.drop("score", *features)
    return AnomalyReport(rows, rows.where("is_anomaly"), points.select("x", "y", "is_anomaly"), explained)
