"""Household panel derived from the order tables (see FIXTURES.md, section 3).

Suppliers act as households, the shipping day of the year as the day and the
summed quantity as litres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmeter.schemas import Inputs

_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "lineitem": "l_suppkey BIGINT, l_quantity DOUBLE, l_shipdate TIMESTAMP_NTZ",
}

# Region to landscape; any other region is a food garden.
_REGION_LANDSCAPE = {
    "AFRICA": "turfgrass_dominant",
    "AMERICA": "hardscape_dominant",
    "ASIA": "container_balcony",
    "EUROPE": "xeriscape_native",
}

DAYS = 365


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A declared schema saves the footer-reading job of schema inference.
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _hemisphere(nation: Column) -> Column:
    return F.when(nation % 2 == 0, "north").otherwise("south").alias("hemisphere")


def panel_household(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _household(_table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region"))


def _household(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    landscape = F.lit("food_homegarden")
    for name, label in _REGION_LANDSCAPE.items():
        landscape = F.when(F.col("r_name") == name, label).otherwise(landscape)
    key = F.col("s_suppkey")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _hemisphere(F.col("s_nationkey")),
            key.alias("household_id"),
            (1 + key % 8).cast("int").alias("occupancy_count"),
            (F.lit(0.15) + (key % 81) / F.lit(100.0)).alias("appliance_efficiency_score"),
            landscape.alias("landscape_type"),
        )
    )


def _readings(lineitem: DataFrame) -> DataFrame:
    day = F.dayofyear("l_shipdate") - 1
    return lineitem.withColumn("day_index", day.cast("int")).where(F.col("day_index") < DAYS)


def panel_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(_readings(_table(spark, sf_dir, "lineitem")), _table(spark, sf_dir, "supplier"))


def _usage(readings: DataFrame, supplier: DataFrame) -> DataFrame:
    """Daily litres; quantities are summed per supplier and day before the join.

    The map-side combine leaves at most 365 rows per supplier and task, so one
    supplier owning a large share of the orders costs nothing extra.
    """
    daily = readings.groupBy("l_suppkey", "day_index").agg(F.sum("l_quantity").alias("liters"))
    sides = supplier.select(F.col("s_suppkey").alias("l_suppkey"), _hemisphere(F.col("s_nationkey")))
    return daily.join(sides, "l_suppkey").select(
        "hemisphere", F.col("l_suppkey").alias("household_id"), "day_index", "liters"
    )


def panel_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _environment(_readings(_table(spark, sf_dir, "lineitem")))


def _environment(readings: DataFrame) -> DataFrame:
    """Weather of both hemispheres: at most 2 x 365 rows, as day numbers are distinct in [0, 365)."""
    day = F.col("day_index")
    angle = 2 * F.pi() / 365
    north = F.lit(15.2) + F.lit(7.15) * F.sin(angle * (day - 30))
    south = F.lit(13.3) - F.lit(3.65) * F.sin(angle * (day - 40))
    dry_season = day.between(150, 239)
    rains = (dry_season & (day % 13 == 0)) | (~dry_season & ((day * 7) % 10 < 3))
    return (
        readings.select("day_index")
        .distinct()
        .withColumn("hemisphere", F.explode(F.array(F.lit("north"), F.lit("south"))))
        .select(
            "hemisphere",
            "day_index",
            F.when(F.col("hemisphere") == "north", F.least(F.greatest(north, F.lit(7.0)), F.lit(35.0)))
            .otherwise(F.least(F.greatest(south, F.lit(9.0)), F.lit(25.0)))
            .alias("daily_max_temp_celsius"),
            F.when(rains, F.lit(0.1) + ((day * 31) % 200) / F.lit(10.0))
            .otherwise(F.lit(0.0))
            .alias("daily_rainfall_mm"),
        )
    )


def load_panel(spark: SparkSession, sf_dir: str) -> Inputs:
    supplier, nation, region, lineitem = (
        _table(spark, sf_dir, name) for name in ("supplier", "nation", "region", "lineitem")
    )
    readings = _readings(lineitem)
    return Inputs(
        household=_household(supplier, nation, region),
        environment=_environment(readings),
        usage=_usage(readings, supplier),
        environment_rows=2 * DAYS,
    )
