"""Household water-behaviour analytics, written for Spark.

Inputs are three keyed tables (household, environment, usage); see
``rillmeter.schemas``. Every public function takes and returns DataFrames.
"""

from rillmeter.schemas import FEATURES, FINAL_FEATURES, Inputs

__all__ = ["FEATURES", "FINAL_FEATURES", "Inputs"]
