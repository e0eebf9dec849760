"""Score households by what was fitted and saved: raw usage in, named archetypes out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmeter.functions.expressions import publish_float
from rillmeter.operators.features import features_of
from rillmeter.operators.scaling import scale
from rillmeter.operators.scoring import load_scorer, score_profiles
from rillmeter.schemas import FINAL_FEATURES, Inputs
from rillmeter.sources.layout import load_fitted


def score_households(spark: SparkSession, data_dir: str, inputs: Inputs) -> DataFrame:
    """Archetype, distances and anomaly flag of every household of ``inputs``.

    Reads what ``run_feature_engineering`` and ``train_clusters`` left in
    ``data_dir``: day flags, scaler parameters, variance mask, centroids and
    training bounds. Only the features are computed anew; the weather is the
    saved one, not that of ``inputs``.
    """
    flags, params, mask = load_fitted(spark, f"{data_dir}/fitted")
    masked = mask.where(~F.col("kept") & F.col("column").isin(list(FINAL_FEATURES))).select("column").distinct().collect()
    if masked:
        raise ValueError(f"the saved variance mask drops {sorted(r['column'] for r in masked)}, which the centroids need")
    centroids, bounds = (spark.read.parquet(f"{data_dir}/{name}") for name in ("centroids", "training_bounds"))
    profiles = scale(features_of(replace(inputs, environment_rows=None), flags), params, FINAL_FEATURES)
    if dict(bounds.dtypes)["lower"] == "float":  # trained on single precision: the extremes themselves are inside
        profiles = publish_float(profiles, FINAL_FEATURES)
    return score_profiles(profiles, load_scorer(centroids, bounds))
