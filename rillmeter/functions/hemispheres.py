"""Per-hemisphere constants and the column expression that selects them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, by hemisphere.
PARAMETERS = {
    "north": {
        "temp_mean": 15.2,
        "temp_amplitude": 7.15,
        "temp_phase": 30,
        "temp_lower": 7.0,
        "temp_upper": 35.0,
        "rain_slope": 0.20,
        "rain_midpoint": 11.35,
        "weekend_multiplier": 1.45,
        "intake_liters": 2.725,
        "per_capita_liters": 200.0,
        "yard_area_sqm": 115.0,
        "occupancy_mean": 2.44 + 1,
        "efficiency_mean": 9.36 / (9.36 + 3.64),
    },
    "south": {
        "temp_mean": 13.3,
        "temp_amplitude": -3.65,
        "temp_phase": 40,
        "temp_lower": 9.0,
        "temp_upper": 25.0,
        "rain_slope": 0.39,
        "rain_midpoint": 11.33,
        "weekend_multiplier": 1.3,
        "intake_liters": 2.35,
        "per_capita_liters": 150.0,
        "yard_area_sqm": 85.0,
        "occupancy_mean": 2.85 + 1,
        "efficiency_mean": 4.22 / (4.22 + 4.55),
    },
}

# Expected share of each landscape label, by hemisphere.
LANDSCAPE_WEIGHTS = {
    "north": {
        "turfgrass_dominant": 0.35,
        "hardscape_dominant": 0.40,
        "container_balcony": 0.15,
        "xeriscape_native": 0.07,
        "food_homegarden": 0.03,
    },
    "south": {
        "turfgrass_dominant": 0.30,
        "hardscape_dominant": 0.45,
        "container_balcony": 0.15,
        "xeriscape_native": 0.07,
        "food_homegarden": 0.03,
    },
}


def parameter(name: str) -> Column:
    """The constant ``name`` for the row's hemisphere; the south's outside the north."""
    return F.when(F.col("hemisphere") == "north", F.lit(PARAMETERS["north"][name])).otherwise(
        F.lit(PARAMETERS["south"][name])
    )
