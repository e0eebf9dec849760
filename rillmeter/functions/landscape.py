"""Landscape labels and their demand coefficients."""

from __future__ import annotations

from pyspark.sql import Column

from rillmeter.functions.expressions import lookup

# Demand coefficient of each landscape label.
LANDSCAPE_COEFFICIENTS = {
    "turfgrass_dominant": 1.0,
    "hardscape_dominant": 0.8,
    "container_balcony": 0.6,
    "xeriscape_native": 0.3,
    "food_homegarden": 0.2,
}
# Coefficient of a label outside the list.
UNKNOWN_COEFFICIENT = 0.5

LANDSCAPE_TYPES = tuple(LANDSCAPE_COEFFICIENTS)


def landscape_coefficient(label: Column) -> Column:
    return lookup(label, LANDSCAPE_COEFFICIENTS, UNKNOWN_COEFFICIENT)
