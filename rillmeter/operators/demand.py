"""Expected daily demand in closed form, and residuals of metered against expected litres."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmeter.functions.calendar import is_weekend
from rillmeter.functions.hemispheres import parameter
from rillmeter.functions.landscape import landscape_coefficient
from rillmeter.schemas import KEYS
from rillmeter.session import DAY_TABLE_LIMIT, small_side

# Smallest daily deficit of a yard.
MIN_DEFICIT = 0.5


def seasonal_baseline(environment: DataFrame) -> DataFrame:
    """Add the seasonal temperature curve and the anomaly of the observed temperature."""
    angle = 2 * F.pi() / 365 * (F.col("day_index") - parameter("temp_phase"))
    curve = parameter("temp_mean") + parameter("temp_amplitude") * F.sin(angle)
    return environment.withColumn("base_seasonal_temp_celsius", F.bround(curve, 2)).withColumn(
        "temp_anomaly_celsius", F.col("daily_max_temp_celsius") - F.col("base_seasonal_temp_celsius")
    )


def rain_probability(environment: DataFrame) -> DataFrame:
    """Add the chance of rain, a falling logistic in the day's temperature."""
    exponent = parameter("rain_slope") * (F.col("daily_max_temp_celsius") - parameter("rain_midpoint"))
    return environment.withColumn("rain_probability", F.bround(F.lit(1.0) / (F.lit(1.0) + F.exp(exponent)), 4))


def environmental_deficit() -> Column:
    warmth = F.greatest(F.col("daily_max_temp_celsius") - parameter("temp_mean"), F.lit(0.0))
    return F.greatest(warmth - F.col("daily_rainfall_mm"), F.lit(MIN_DEFICIT))


def indoor_demand() -> Column:
    multiplier = F.when(is_weekend(F.col("day_index")), parameter("weekend_multiplier")).otherwise(F.lit(1.0))
    people = F.col("occupancy_count") * multiplier * parameter("per_capita_liters")
    return (parameter("intake_liters") + people) * (F.lit(2.0) - F.col("appliance_efficiency_score"))


def outdoor_demand() -> Column:
    return F.col("deficit") * parameter("yard_area_sqm") * landscape_coefficient(F.col("landscape_type"))


def _with_demand(df: DataFrame) -> DataFrame:
    floor = F.col("occupancy_count") * parameter("intake_liters")
    return df.withColumns({"indoor_liters": indoor_demand(), "outdoor_liters": outdoor_demand()}).withColumn(
        "expected_liters", F.greatest(F.col("indoor_liters") + F.col("outdoor_liters"), floor)
    )


def day_deficits(environment: DataFrame) -> DataFrame:
    return environment.select("hemisphere", "day_index", environmental_deficit().alias("deficit"))


def year_arrays(days: DataFrame, known_rows: int | None = None, rows_per_part: int = DAY_TABLE_LIMIT) -> list[DataFrame]:
    """The day table as one row per hemisphere, ``(hemisphere, days ARRAY<STRUCT<day_index, deficit>>)``.

    A table of more than ``rows_per_part`` days comes in several parts, each of about that many days at most, dealt by a
    hash of the day.
    """
    rows = days.count() if known_rows is None else known_rows
    parts = max(-(-rows // rows_per_part), 1)
    part = F.pmod(F.xxhash64("day_index"), F.lit(parts))
    own = lambda i: days if parts == 1 else days.where(part == i)
    return [own(i).groupBy("hemisphere").agg(F.array_sort(F.collect_list(F.struct("day_index", "deficit"))).alias("days")) for i in range(parts)]


def expected_usage(household: DataFrame, environment: DataFrame, environment_rows: int | None = None, rows_per_part: int = DAY_TABLE_LIMIT) -> DataFrame:
    """Expected litres for every household and day of its hemisphere.

    The result has one row per household and day by definition. Each household meets its hemisphere's days as one array, a
    broadcast of one row per hemisphere, and opens it where it is: households are never shuffled by hemisphere, however
    long the day table is. A day that stands twice in it counts twice.
    """
    parts = []
    for years in year_arrays(day_deficits(environment), environment_rows, rows_per_part):
        met = household.join(F.broadcast(years), "hemisphere").withColumn("day", F.explode("days")).drop("days")
        parts.append(_with_demand(met.withColumns({"day_index": F.col("day.day_index"), "deficit": F.col("day.deficit")})))
    return reduce(DataFrame.unionByName, parts).select(*KEYS, "day_index", "indoor_liters", "outdoor_liters", "expected_liters")


def usage_residuals(
    household: DataFrame, usage: DataFrame, environment: DataFrame, environment_rows: int | None = None
) -> DataFrame:
    """Metered minus expected litres for every metered day.

    Starts from the readings, so no household-by-day product is built.
    """
    days = small_side(day_deficits(environment), known_rows=environment_rows)
    metered = usage.join(days, ["hemisphere", "day_index"]).join(household, list(KEYS))
    return _with_demand(metered).select(
        *KEYS, "day_index", "liters", "expected_liters",
        (F.col("liters") - F.col("expected_liters")).alias("residual"),
    )


def residual_summary(residuals: DataFrame) -> DataFrame:
    """Per household: residual mean and spread, and the day with the largest absolute residual.

    The grouping reuses the partitioning of the household join.
    """
    size = F.abs(F.col("residual"))
    return residuals.groupBy(*KEYS).agg(
        F.avg("residual").alias("residual_mean"),
        F.stddev_pop("residual").alias("residual_std"),
        F.max(size).alias("largest_abs_residual"),
        F.max_by("day_index", F.struct(size, -F.col("day_index"))).alias("largest_day"),
    )
