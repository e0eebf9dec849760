"""Tables the queries start from, all derived from the given data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmeter.functions.calendar import env_flags
from rillmeter.operators.clustering import name_archetypes
from rillmeter.operators.features import features_of, moment_statistics, usage_statistics
from rillmeter.operators.scaling import fit_robust, fit_scaler, scale
from rillmeter.operators.scoring import Scorer, load_scorer, training_bounds
from rillmeter.schemas import FINAL_FEATURES, KEYS, Inputs
from rillmeter.session import materialise, scratch_path
from rillmeter.sources.layout import write_positional
from rillmeter.sources.panel import load_panel

_POSITIONAL: dict[tuple[str, str], str] = {}


def panel(spark: SparkSession, sf_dir: str) -> Inputs:
    return load_panel(spark, sf_dir)


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return env_flags(panel(spark, sf_dir).environment)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return usage_statistics(p.usage, env_flags(p.environment), p.environment_rows)


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return moment_statistics(p.usage, env_flags(p.environment), p.environment_rows)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_of(panel(spark, sf_dir))


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(features(spark, sf_dir), "features")


def stored_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(panel(spark, sf_dir).usage, "usage")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    unscaled = stored_features(spark, sf_dir)
    return scale(unscaled, fit_scaler(unscaled))


def stored_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four clustering features; all are robust-scaled, so no lambda is searched."""
    unscaled = stored_features(spark, sf_dir)
    return materialise(scale(unscaled, fit_robust(unscaled, FINAL_FEATURES), FINAL_FEATURES), "final")


def class_centroids(final: DataFrame, household: DataFrame) -> DataFrame:
    """Mean position of four occupancy classes: centroids every engine can compute."""
    label = F.floor((F.col("occupancy_count") - 1) / 2).cast("int").alias("cluster_id")
    return (
        final.join(household.select(*KEYS, "occupancy_count"), list(KEYS))
        .groupBy("hemisphere", label)
        .agg(F.array(*[F.avg(c) for c in FINAL_FEATURES]).alias("centroid"))
    )


def class_scorer(spark: SparkSession, sf_dir: str, final: DataFrame, bounds: bool = False) -> Scorer:
    centroids = name_archetypes(materialise(class_centroids(final, panel(spark, sf_dir).household), "centroids"))
    return load_scorer(centroids, training_bounds(final) if bounds else None)


def positional_copy(spark: SparkSession, sf_dir: str) -> str:
    """Folder holding the panel in the positional layout, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _POSITIONAL:
        path = scratch_path(spark, "positional")
        write_positional(panel(spark, sf_dir), path)
        _POSITIONAL[key] = path
    return _POSITIONAL[key]
