"""Table schemas, column lists and the bundle of the three inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

HEMISPHERES = ("north", "south")

#: Keys carried by every household-level table.
KEYS = ("hemisphere", "household_id")

HOUSEHOLD_SCHEMA = T.StructType(
    [
        T.StructField("household_id", T.StringType()),
        T.StructField("occupancy_count", T.ShortType()),
        T.StructField("appliance_efficiency_score", T.FloatType()),
        T.StructField("landscape_type", T.StringType()),
    ]
)

ENVIRONMENT_SCHEMA = T.StructType(
    [
        T.StructField("daily_max_temp_celsius", T.FloatType()),
        T.StructField("daily_rainfall_mm", T.FloatType()),
    ]
)

USAGE_SCHEMA = T.StructType(
    [
        T.StructField("hemisphere", T.StringType()),
        T.StructField("household_id", T.StringType()),
        T.StructField("day_index", T.IntegerType()),
        T.StructField("liters", T.FloatType()),
    ]
)

# The ten feature names, in publication order.
FEATURES = (
    "log_per_capita_usage",
    "efficiency_penalty_ratio",
    "water_usage_cv",
    "dry_day_spike_factor",
    "temp_sensitivity_corr",
    "weekend_weekday_ratio",
    "landscape_demand_index",
    "seasonal_amplitude_ratio",
    "drought_responsiveness_index",
    "baseline_peak_ratio",
)

# Columns scaled by median and 5-95 range, in output order.
ROBUST_COLUMNS = (
    "log_per_capita_usage",
    "dry_day_spike_factor",
    "drought_responsiveness_index",
    "efficiency_penalty_ratio",
    "weekend_weekday_ratio",
    "landscape_demand_index",
    "seasonal_amplitude_ratio",
    "baseline_peak_ratio",
)

# Columns scaled by the Yeo-Johnson transform, in output order.
POWER_COLUMNS = ("water_usage_cv", "temp_sensitivity_corr")

SCALED_ORDER = ROBUST_COLUMNS + POWER_COLUMNS

# Columns dropped as collinear before clustering.
COLLINEAR_COLUMNS = (
    "drought_responsiveness_index",
    "seasonal_amplitude_ratio",
    "weekend_weekday_ratio",
    "baseline_peak_ratio",
    "water_usage_cv",
    "temp_sensitivity_corr",
)

#: The clustering features. Archetype naming reads the first and the last one.
FINAL_FEATURES = tuple(c for c in SCALED_ORDER if c not in COLLINEAR_COLUMNS)


@dataclass(frozen=True)
class Inputs:
    """The three input tables of both hemispheres.

    ``usage`` holds one row per household and day, so a household owns at most
    a year of rows. ``environment_rows`` is an upper bound of the environment
    table known to whoever built it; ``None`` means nobody has counted yet.

    ``matrix`` and ``positions`` are set when usage came as a wide table: the
    year of each row as arrays ``day_index`` and ``liters``, and the household
    behind each ``row_number``. They spare the features a shuffle of ``usage``.
    """

    household: DataFrame
    environment: DataFrame
    usage: DataFrame
    environment_rows: int | None = None
    matrix: DataFrame | None = None
    positions: DataFrame | None = None
