"""From the three inputs to scaled, selected features, for both hemispheres at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rillmeter.functions.calendar import env_flags
from rillmeter.functions.expressions import publish_float
from rillmeter.operators.features import features_of
from rillmeter.operators.quality import Expectations, check_inputs, require_clean
from rillmeter.operators.scaling import fit_scaler, scale
from rillmeter.operators.selection import keep_columns, reduce_collinear, variance_filter, variance_table
from rillmeter.schemas import FINAL_FEATURES, KEYS, SCALED_ORDER, Inputs
from rillmeter.session import materialise
from rillmeter.sources.layout import load_inputs, save_fitted, write_keyed


@dataclass(frozen=True)
class Engineered:
    """Outcome of feature engineering; ``unscaled`` and ``scaled`` hold all ten features."""

    flags: DataFrame
    unscaled: DataFrame
    params: DataFrame
    scaled: DataFrame
    kept: dict[str, list[str]]
    selected: DataFrame
    final: DataFrame


def engineer(inputs: Inputs) -> Engineered:
    """Extract once, store the unscaled features, then fit and apply the scalers on the stored table."""
    flags = env_flags(inputs.environment)
    unscaled = materialise(features_of(inputs, flags), "unscaled")
    params = fit_scaler(unscaled)
    scaled = scale(unscaled, params)
    kept = variance_filter(scaled, SCALED_ORDER)
    selected = keep_columns(scaled, kept, SCALED_ORDER)
    return Engineered(flags, unscaled, params, scaled, kept, selected, reduce_collinear(selected))


def run_feature_engineering(
    spark: SparkSession, in_dir: str, out_dir: str, expected: Expectations = Expectations(), strict: bool = True
) -> Engineered:
    """Load the positional layout, check it, and write features, unscaled and final tables and the fitted state."""
    inputs = load_inputs(spark, in_dir)
    if strict:
        require_clean(check_inputs(inputs, expected))
    done = engineer(inputs)
    names = [c for c in SCALED_ORDER if c in done.selected.columns]
    write_keyed(publish_float(done.selected, names), f"{out_dir}/features")
    write_keyed(publish_float(done.unscaled.select(*KEYS, *FINAL_FEATURES), FINAL_FEATURES), f"{out_dir}/unscaled")
    final = [c for c in FINAL_FEATURES if c in done.final.columns]
    write_keyed(publish_float(done.final, final), f"{out_dir}/final")
    save_fitted(f"{out_dir}/fitted", done.flags, done.params, variance_table(done.scaled, SCALED_ORDER))
    return done
