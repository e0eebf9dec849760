"""Small hand-made inputs."""

from rillmeter.schemas import Inputs

HOUSEHOLD = "hemisphere STRING, household_id STRING, occupancy_count INT, appliance_efficiency_score DOUBLE, landscape_type STRING"
ENVIRONMENT = "hemisphere STRING, day_index INT, daily_max_temp_celsius DOUBLE, daily_rainfall_mm DOUBLE"
USAGE = "hemisphere STRING, household_id STRING, day_index INT, liters DOUBLE"


def household(spark, rows):
    return spark.createDataFrame(rows, HOUSEHOLD)


def environment(spark, rain, temp=None, hemisphere="north"):
    temp = temp or [10.0 + d for d in range(len(rain))]
    return spark.createDataFrame([(hemisphere, d, float(t), float(r)) for d, (t, r) in enumerate(zip(temp, rain))], ENVIRONMENT)


def usage(spark, liters_by_household, hemisphere="north"):
    rows = [(hemisphere, h, d, None if x is None else float(x)) for h, xs in liters_by_household.items() for d, x in enumerate(xs)]
    return spark.createDataFrame(rows, USAGE)


def inputs(spark, liters_by_household, rain, temp=None, landscape="turfgrass_dominant", hemisphere="north"):
    people = [(hemisphere, h, 2, 0.5, landscape) for h in liters_by_household]
    return Inputs(
        household(spark, people), environment(spark, rain, temp, hemisphere), usage(spark, liters_by_household, hemisphere)
    )
