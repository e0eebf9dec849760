"""Train, name and apply the household archetypes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession

from rillmeter.operators.clustering import CLUSTERS, TRAINING_SEED, centroid_table, name_archetypes, train_models
from rillmeter.operators.profile import box_summary
from rillmeter.operators.scoring import Scorer, load_scorer, score_profiles, training_bounds
from rillmeter.schemas import FINAL_FEATURES, KEYS
from rillmeter.sources.layout import read_keyed, write_keyed


@dataclass(frozen=True)
class Clustered:
    """One model per hemisphere, the named centroids, the scorer and the labelled rows."""

    models: dict[str, KMeansModel]
    centroids: DataFrame
    scorer: Scorer
    assignments: DataFrame


def cluster(final: DataFrame, k: int = CLUSTERS, seed: int = TRAINING_SEED, n_starts: int = 1) -> Clustered:
    """Fit both hemispheres on the stored final features and score every household."""
    models = train_models(final, FINAL_FEATURES, k, seed, n_starts)
    centroids = name_archetypes(centroid_table(final.sparkSession, models))
    scorer = load_scorer(centroids, training_bounds(final))
    return Clustered(models, centroids, scorer, score_profiles(final, scorer))


def archetype_profiles(unscaled: DataFrame, assignments: DataFrame) -> DataFrame:
    """Box summary of the unscaled features by cluster."""
    labelled = unscaled.join(assignments.select(*KEYS, "cluster_id"), list(KEYS))
    return box_summary(labelled, "cluster_id", FINAL_FEATURES)


def train_clusters(spark: SparkSession, data_dir: str, k: int = CLUSTERS, seed: int = TRAINING_SEED) -> Clustered:
    """Read the final features, cluster them, and write labels, centroids and models next to them."""
    done = cluster(read_keyed(spark, f"{data_dir}/final"), k, seed)
    write_keyed(done.assignments, f"{data_dir}/final_with_clusters")
    done.centroids.write.mode("overwrite").parquet(f"{data_dir}/centroids")
    training_bounds(read_keyed(spark, f"{data_dir}/final")).write.mode("overwrite").parquet(f"{data_dir}/training_bounds")
    for h, model in done.models.items():
        model.write().overwrite().save(f"{data_dir}/fitted/kmeans_{h}")
    return done
