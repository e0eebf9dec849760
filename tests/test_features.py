import math

import numpy as np
import pytest
from fixtures import household, inputs, usage
from pyspark.sql import functions as F

from rillmeter.functions.calendar import env_flags
from rillmeter.operators.features import daily_usage, extract_features, features_of, household_years, moment_statistics, year_statistics
from rillmeter.schemas import FEATURES

RAIN = [0, 0, 0, 5, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0]


def one(df, household_id="a"):
    return df.where(F.col("household_id") == household_id).first().asDict()


def numpy_features(liters, rain, temp, occupancy=2, efficiency=0.5):
    x, rain, temp = np.array(liters, float), np.array(rain, float), np.array(temp, float)
    days = np.arange(len(x))
    dry, weekend = rain < 0.1, days % 7 >= 5
    summer = (days >= 91) & (days <= 273)
    drought = np.convolve(dry.astype(float), np.ones(7), mode="same") >= 6
    m = x.mean()
    return {
        "log_per_capita_usage": math.log1p(m / occupancy),
        "efficiency_penalty_ratio": 2 - efficiency,
        "water_usage_cv": x.std() / m,
        "dry_day_spike_factor": x[dry].mean() / x[~dry].mean(),
        "temp_sensitivity_corr": max(np.corrcoef(x, temp)[0, 1], -0.5),
        "weekend_weekday_ratio": max(x[weekend].mean() / x[~weekend].mean(), 0.75),
        "landscape_demand_index": 1.0,
        "drought_responsiveness_index": x[drought].mean() / m if drought.any() else 1.0,
        "baseline_peak_ratio": np.percentile(x, 25) / np.percentile(x, 95),
    }


def test_tiny_panel_against_numpy(spark):
    liters = [5, 9, 7, 3, 8, 2, 9, 4, 6, 6, 1, 7, 8, 12]
    temp = [10 + d for d in range(14)]
    row = one(features_of(inputs(spark, {"a": liters, "b": liters[::-1]}, RAIN, temp)))
    for name, value in numpy_features(liters, RAIN, temp).items():
        assert row[name] == pytest.approx(value, abs=1e-12), name
    # All fourteen days lie in the northern winter.
    assert row["seasonal_amplitude_ratio"] is None
    south = features_of(inputs(spark, {"a": liters}, RAIN, temp, hemisphere="south"))
    assert one(south)["seasonal_amplitude_ratio"] == 1.0


def test_full_year_against_numpy(spark):
    rng = np.random.default_rng(1)
    liters = rng.gamma(4, 50, 365).round(3).tolist()
    rain = np.where(rng.random(365) < 0.2, rng.random(365) * 9 + 0.1, 0.0).tolist()
    temp = (15 + 7 * np.sin(np.arange(365) / 58)).tolist()
    row = one(features_of(inputs(spark, {"a": liters}, rain, temp)))
    expected = numpy_features(liters, rain, temp)
    x = np.array(liters)
    expected["seasonal_amplitude_ratio"] = x[91:274].mean() / np.r_[x[:91], x[274:]].mean()
    assert set(expected) == set(FEATURES)
    for name, value in expected.items():
        assert row[name] == pytest.approx(value, rel=1e-10), name


def test_all_dry_takes_the_default(spark):
    assert one(features_of(inputs(spark, {"a": range(1, 15)}, [0] * 14)))["dry_day_spike_factor"] == 1.0


def test_all_wet(spark):
    row = one(features_of(inputs(spark, {"a": range(1, 15)}, [3] * 14)))
    assert row["drought_responsiveness_index"] == 1.0
    assert row["dry_day_spike_factor"] is None


def test_constant_usage_has_no_correlation(spark):
    row = one(features_of(inputs(spark, {"a": [7] * 14}, RAIN)))
    assert row["temp_sensitivity_corr"] == 0.0 and row["water_usage_cv"] == 0.0 and row["baseline_peak_ratio"] == 1.0


def test_zero_usage_takes_all_defaults(spark):
    row = one(features_of(inputs(spark, {"a": [0] * 14}, RAIN)))
    assert row["water_usage_cv"] == 0.0
    for name in ("dry_day_spike_factor", "weekend_weekday_ratio", "drought_responsiveness_index", "baseline_peak_ratio"):
        assert row[name] == 1.0


def test_unknown_landscape(spark):
    assert one(features_of(inputs(spark, {"a": range(1, 15)}, RAIN, landscape="gravel")))["landscape_demand_index"] == 0.5


def test_nan_and_null_readings_are_left_out(spark):
    whole = one(features_of(inputs(spark, {"a": [4.0, 8.0]}, [0, 1])))
    holes = one(features_of(inputs(spark, {"a": [4.0, 8.0, float("nan"), None]}, [0, 1, 0, 0])))
    for name in ("log_per_capita_usage", "water_usage_cv", "baseline_peak_ratio", "dry_day_spike_factor"):
        assert holes[name] == whole[name]


def test_drought_window_is_cut_at_both_ends(spark):
    flags = env_flags(inputs(spark, {"a": [1] * 12}, [0] * 12).environment).orderBy("day_index").collect()
    assert [r["dry_in_window"] for r in flags] == np.convolve(np.ones(12), np.ones(7), mode="same").astype(int).tolist()
    assert [r["is_drought"] for r in flags] == [False, False] + [True] * 8 + [False, False]


def test_rows_may_come_in_any_order(spark):
    panel = inputs(spark, {"a": range(1, 15), "b": range(15, 1, -1)}, RAIN)
    flags = env_flags(panel.environment)
    first = sorted(extract_features(panel.household, panel.usage, flags).collect())
    shuffled = panel.usage.orderBy(F.rand(3)).repartition(5)
    assert sorted(extract_features(panel.household, shuffled, flags).collect()) == first


def test_repeated_readings_are_summed_per_day(spark):
    whole = usage(spark, {"a": [4, 6, 8]})
    parts = whole.withColumn("liters", F.col("liters") / 2)
    assert sorted(daily_usage(parts.unionByName(parts)).collect()) == sorted(whole.collect())


def test_days_without_weather_are_ignored(spark):
    panel = inputs(spark, {"a": [4, 6, 8, 100]}, [0, 1, 0])
    stats = year_statistics(household_years(panel.usage), env_flags(panel.environment)).first()
    assert stats["n_days"] == 3 and stats["mean_usage"] == 6.0


def test_occupancy_below_one_counts_as_one(spark):
    panel = inputs(spark, {"a": [4, 4]}, [0, 1])
    nobody = household(spark, [("north", "a", 0, 0.5, "xeriscape_native")])
    row = extract_features(nobody, panel.usage, env_flags(panel.environment)).first()
    assert row["log_per_capita_usage"] == pytest.approx(math.log1p(4))


def test_large_day_table_is_joined_instead_of_broadcast(spark):
    panel = inputs(spark, {"a": [5, 9, 7, 3, 8, 2, 9, 4], "b": [1, 2, 3, 4, 5, 6, 7, 8]}, RAIN[:8])
    flags = env_flags(panel.environment)
    few, many = (sorted(extract_features(panel.household, panel.usage, flags, rows).collect()) for rows in (8, 10**9))
    assert few == many


def test_unknown_rain_is_wet_and_keeps_the_day(spark):
    panel = inputs(spark, {"a": [5, 9, 7, 5000, 8, 2, 9, 4]}, RAIN[:8])
    rain = F.when(F.col("day_index") != 3, F.col("daily_rainfall_mm"))
    flags = env_flags(panel.environment.withColumn("daily_rainfall_mm", rain))
    few, many = (year_statistics(household_years(panel.usage), flags, flag_rows=n).first() for n in (8, 10**9))
    assert few == many and few["n_days"] == 8 and few["mean_usage"] == 630.5


def test_percentiles_leave_out_days_without_weather(spark):
    panel = inputs(spark, {"a": [5, 9, 7, 5000, 8, 2, 9, 4]}, RAIN[:8])
    flags = env_flags(panel.environment).where("day_index <> 3")
    for n in (8, 10**9):
        row = year_statistics(household_years(panel.usage), flags, flag_rows=n).first()
        assert row["n_days"] == 7 and (row["p25"], row["p95"]) == (4.5, 9.0)


def test_moments_without_arrays_are_the_same(spark):
    panel = inputs(spark, {"a": [5, 9, 7, 5000, 8, None, float("nan"), 4], "b": [1, 2, 3, 4, 5, 6, 7, 8]}, RAIN[:8])
    flags = env_flags(panel.environment).where("day_index <> 3")
    moments = moment_statistics(panel.usage, flags)
    arrays = {r["household_id"]: r for r in year_statistics(household_years(panel.usage), flags).collect()}
    for row in moments.collect():
        for name in moments.columns:
            other = arrays[row["household_id"]][name]
            assert row[name] == (pytest.approx(other) if isinstance(other, float) else other)
