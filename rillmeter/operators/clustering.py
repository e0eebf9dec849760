"""k-means per hemisphere, archetype names and cluster-suitability measures."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmeter.operators.lloyd import Fit, best_starts, fit_together, silhouettes_together
from rillmeter.operators.ranking import local_table
from rillmeter.operators.sampling import sample_rows
from rillmeter.operators.scoring import Scorer, euclidean, nearest, score_profiles
from rillmeter.schemas import FINAL_FEATURES, KEYS
from rillmeter.session import materialise

# Clusters and seeds of the training and the suitability study.
CLUSTERS = 4
TRAINING_SEED = 2033
STUDY_SEED = 42
SILHOUETTE_SAMPLE = 2_000
MAX_PCA_COMPONENTS = 15

#: Independent fits submitted at the same time.
PARALLEL_FITS = 8

# Archetype names.
LOW_VOLUME = "Conservationists (Low Volume)"
HIGH_VOLUME = "Heavy Users (High Volume)"
OUTDOOR = "Outdoor/Landscape Heavy"
STANDARD = "Standard Average Consumers"

CENTROIDS_DDL = "hemisphere STRING, cluster_id INT, centroid ARRAY<DOUBLE>"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="vector").transform(df)


def best_kmeans(
    df: DataFrame, features: Sequence[str], k: int, seed: int, n_starts: int = 1, max_iter: int = 300
) -> KMeansModel:
    """Fit k-means ``n_starts`` times and keep the cheapest model."""
    vectors = assemble(df.select(*features), features).select("vector")
    vectors.persist()
    try:
        fits = [
            KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=1e-6, featuresCol="vector").fit(vectors)
            for i in range(n_starts)
        ]
    finally:
        vectors.unpersist()
    return min(fits, key=lambda m: m.summary.trainingCost)


def centroid_literals(model: KMeansModel) -> list[list[float]]:
    return [[float(x) for x in c] for c in model.clusterCenters()]


def label_rows(df: DataFrame, model: KMeansModel, features: Sequence[str]) -> DataFrame:
    """Add the predicted cluster as ``label``."""
    labelled = model.setPredictionCol("label").transform(assemble(df, features))
    return labelled.drop("vector")


def hemispheres_of(df: DataFrame) -> list[str]:
    return [r["hemisphere"] for r in df.select("hemisphere").distinct().orderBy("hemisphere").collect()]


def train_models(
    df: DataFrame, features: Sequence[str] = FINAL_FEATURES, k: int = CLUSTERS, seed: int = TRAINING_SEED, n_starts: int = 1
) -> dict[str, KMeansModel]:
    """One model per hemisphere, fitted side by side."""
    names = hemispheres_of(df)
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        models = pool.map(lambda h: best_kmeans(df.where(F.col("hemisphere") == h), features, k, seed, n_starts), names)
        return dict(zip(names, models))


def centroid_table(spark: SparkSession, models: dict[str, KMeansModel]) -> DataFrame:
    rows = [(h, i, c) for h, m in models.items() for i, c in enumerate(centroid_literals(m))]
    data = {"hemisphere": [r[0] for r in rows], "cluster_id": [r[1] for r in rows], "centroid": [r[2] for r in rows]}
    return local_table(spark, data, CENTROIDS_DDL)


def name_archetypes(centroids: DataFrame) -> DataFrame:
    """Name clusters by centroid: extremes of usage (first coordinate), then landscape (last one).

    Makes cluster meaning independent of the numbering k-means happens to give.
    """
    own = Window.partitionBy("hemisphere")
    cluster, usage, landscape = F.col("cluster_id"), F.col("centroid")[0], F.element_at("centroid", -1)
    between = (cluster != F.col("lowest")) & (cluster != F.col("highest"))
    name = (
        F.when(cluster == F.col("lowest"), LOW_VOLUME)
        .when(cluster == F.col("highest"), HIGH_VOLUME)
        .when(cluster == F.col("outdoor"), OUTDOOR)
        .otherwise(STANDARD)
    )
    return (
        centroids.withColumn("lowest", F.min_by(cluster, F.struct(usage, cluster)).over(own))
        .withColumn("highest", F.max_by(cluster, F.struct(usage, cluster)).over(own))
        .withColumn("outdoor", F.max_by(cluster, F.when(between, F.struct(landscape, cluster))).over(own))
        .select("hemisphere", "cluster_id", "centroid", name.alias("archetype"))
    )


def assign_clusters(df: DataFrame, models: dict[str, KMeansModel], features: Sequence[str] = FINAL_FEATURES) -> DataFrame:
    """Attach the nearest centroid of the row's hemisphere as text ``cluster_id``."""
    scorer = Scorer({h: centroid_literals(m) for h, m in models.items()})
    return score_profiles(df, scorer, features=features).drop("archetype", "is_anomaly", "distances", "min_distance")


def inertia(df: DataFrame, model: KMeansModel, features: Sequence[str]) -> float:
    """Sum of squared distances to the nearest centroid."""
    gaps = [euclidean(features, c) for c in centroid_literals(model)]
    near = F.array_min(F.array(*gaps))
    return df.select(F.sum(near * near).alias("cost")).first()["cost"]


def _point_silhouettes(points: np.ndarray, labels: np.ndarray) -> np.ndarray:
    distances = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    clusters, own = np.unique(labels, return_inverse=True)
    sums = np.stack([distances[:, labels == c].sum(axis=1) for c in clusters], axis=1)
    sizes = np.bincount(own)
    rows = np.arange(len(points))
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = sums[rows, own] / (sizes[own] - 1)
        means = sums / sizes
        means[rows, own] = np.inf
        outer = means.min(axis=1)
        score = (outer - inner) / np.maximum(inner, outer)
    return np.where(sizes[own] == 1, 0.0, np.nan_to_num(score))


def silhouettes(sample: DataFrame, features: Sequence[str], by: Sequence[str], label: str = "label") -> DataFrame:
    """Euclidean silhouette per group of an already bounded sample.

    Each group is compared pairwise inside one task, so hand in samples (see
    ``SILHOUETTE_SAMPLE``), never whole tables. One cluster alone gives NULL.
    """
    names = list(features)

    def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = pdf[label].to_numpy()
        score = None
        if len(np.unique(labels)) > 1:
            score = float(_point_silhouettes(pdf[names].to_numpy(dtype=float), labels).mean())
        return pdf.iloc[:1][list(by)].assign(n=len(pdf), silhouette=score)

    ddl = ", ".join([f"{b} {sample.schema[b].dataType.simpleString()}" for b in by] + ["n BIGINT", "silhouette DOUBLE"])
    return sample.select(*by, *names, label).groupBy(*by).applyInPandas(one_group, ddl)


def silhouette(sample: DataFrame, features: Sequence[str]) -> float | None:
    """Euclidean silhouette of one bounded, labelled sample."""
    row = silhouettes(sample.withColumn("whole", F.lit(1)), features, ["whole"]).first()
    return row["silhouette"] if row else None


def squared_silhouette(df: DataFrame, features: Sequence[str]) -> float | None:
    """Squared-Euclidean silhouette of all rows, in one distributed pass per cluster statistics."""
    if df.select("label").distinct().limit(2).count() < 2:
        return None
    evaluator = ClusteringEvaluator(predictionCol="label", featuresCol="vector", metricName="silhouette")
    return evaluator.evaluate(assemble(df, features))


def pca_ratios(df: DataFrame, features: Sequence[str]) -> list[float]:
    """Explained-variance ratios, largest first."""
    components = min(MAX_PCA_COMPONENTS, len(features))
    vectors = assemble(df.select(*features), features).select("vector")
    return [float(x) for x in PCA(k=components, inputCol="vector", outputCol="pc").fit(vectors).explainedVariance]


#: Starts of every k in the suitability study.
STUDY_STARTS = 5
STUDY_METRICS = ("pca_variance_ratio", "inertia", "silhouette", "squared_silhouette")


def cluster_suitability(
    df: DataFrame, features: Sequence[str] = FINAL_FEATURES, max_k: int = 8, seed: int = STUDY_SEED,
    sample_size: int = SILHOUETTE_SAMPLE, metrics: Sequence[str] = STUDY_METRICS, n_starts: int = STUDY_STARTS,
) -> DataFrame:
    """PCA ratios, inertia and both silhouettes for k = 2..max_k, long form ``(hemisphere, metric, k, value)``.

    For the PCA rows ``k`` is the component number. The Euclidean silhouette is
    taken over a sample, as it compares every pair; the squared one over all
    rows. Every k and start of both hemispheres is fitted in the same passes, and
    the inertia is the cost the last of them has added up.
    """
    spark = df.sparkSession
    stored = materialise(df.select(*KEYS, *features), "study")
    groups = hemispheres_of(stored)
    rows: list[tuple] = []
    if "pca_variance_ratio" in metrics:
        for h in groups:
            rows += [(h, "pca_variance_ratio", i + 1, v) for i, v in enumerate(pca_ratios(stored.where(F.col("hemisphere") == h), features))]
    if set(metrics) != {"pca_variance_ratio"}:
        whole = tuple(range(len(features)))
        asked = [Fit(h, whole, k, start) for h in groups for k in range(2, max_k + 1) for start in range(n_starts)]
        fits = [f for f in best_starts(fit_together(stored, asked, features, KEYS, seed=seed)[0]) if f.centres is not None]
        if "inertia" in metrics:
            rows += [(f.group, "inertia", f.k, f.cost) for f in fits]
        if "squared_silhouette" in metrics:
            scores = silhouettes_together(stored, fits, features, KEYS)
            rows += [(f.group, "squared_silhouette", f.k, s.squared) for f, s in zip(fits, scores)]
        if "silhouette" in metrics:
            for h in groups:
                sample = sample_rows(stored.where(F.col("hemisphere") == h), KEYS, sample_size, seed)
                labels = [
                    F.struct(F.lit(f.k).alias("k"), nearest(F.array(*[euclidean(features, c.tolist()) for c in f.centres])).alias("label"))
                    for f in fits if f.group == h
                ]
                wide = sample.select("hemisphere", *features, F.explode(F.array(*labels)).alias("fit"))
                scored = silhouettes(wide.select("*", "fit.k", "fit.label"), features, ["hemisphere", "k"])
                rows += [(r["hemisphere"], "silhouette", r["k"], r["silhouette"]) for r in scored.collect()]
    data = {n: [r[i] for r in rows] for i, n in enumerate(("hemisphere", "metric", "k", "value"))}
    return local_table(spark, data, "hemisphere STRING, metric STRING, k INT, value DOUBLE")
