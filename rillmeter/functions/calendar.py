"""Day arithmetic and the per-day flag table.

Day 0 behaves as a Monday; there are no dates in the data model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rain below this many millimetres is a dry day.
DRY_BELOW_MM = 0.1
# First and last day of the northern summer half-year.
NORTH_SUMMER = (91, 273)
# A drought day has 6 dry days in the 7 days centred on it.
DROUGHT_HALF_WINDOW = 3
DROUGHT_MIN_DRY_DAYS = 6


def is_weekend(day: Column) -> Column:
    return (day % 7) >= 5


def is_summer(hemisphere: Column, day: Column) -> Column:
    north_summer = day.between(*NORTH_SUMMER)
    return F.when(hemisphere == "north", north_summer).otherwise(~north_summer)


def is_dry(rain: Column) -> Column:
    """Never NULL: a day whose rain is unknown is not dry, and still is a day with weather."""
    return F.coalesce(rain < F.lit(DRY_BELOW_MM), F.lit(False))


def env_flags(environment: DataFrame) -> DataFrame:
    """One row per hemisphere and day with the masks the features need.

    The window runs over the day table only (a year per hemisphere). Frames are
    cut at both ends, which equals padding the year with wet days.
    """
    centred = (
        Window.partitionBy("hemisphere")
        .orderBy("day_index")
        .rowsBetween(-DROUGHT_HALF_WINDOW, DROUGHT_HALF_WINDOW)
    )
    year = Window.partitionBy("hemisphere")
    return (
        environment.withColumn("is_dry", is_dry(F.col("daily_rainfall_mm")))
        .withColumn("dry_in_window", F.sum(F.col("is_dry").cast("int")).over(centred))
        .withColumn("is_drought", F.col("dry_in_window") >= DROUGHT_MIN_DRY_DAYS)
        .withColumn("any_drought", F.bool_or("is_drought").over(year))
        .select(
            "hemisphere",
            "day_index",
            F.col("daily_max_temp_celsius").cast("double").alias("temp"),
            "is_dry",
            is_weekend(F.col("day_index")).alias("is_weekend"),
            is_summer(F.col("hemisphere"), F.col("day_index")).alias("is_summer"),
            "dry_in_window",
            "is_drought",
            "any_drought",
        )
    )
