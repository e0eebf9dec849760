"""The ten behavioural features, from one pass over daily usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmeter.functions.calendar import env_flags
from rillmeter.functions.expressions import clip, guarded_ratio, nan_to, nan_to_null
from rillmeter.functions.landscape import landscape_coefficient
from rillmeter.schemas import FEATURES, KEYS, Inputs
from rillmeter.session import DAY_TABLE_LIMIT, small_side

# Bounds of the clipped features.
MIN_TEMP_CORRELATION = -0.5
MIN_WEEKEND_RATIO = 0.75


def daily_usage(readings: DataFrame) -> DataFrame:
    """Sum raw readings to one row per household and day.

    Run this first if a household may report several times a day. The sum is
    combined map-side, so a household with a third of all readings shuffles at
    most a year of rows per task, and every later group is a year long.
    """
    return readings.groupBy(*KEYS, "day_index").agg(F.sum("liters").alias("liters"))


def with_flags(usage: DataFrame, flags: DataFrame, flag_rows: int | None = None) -> DataFrame:
    """Attach the day flags to every reading; no shuffle while the day table is small."""
    return usage.join(small_side(flags, known_rows=flag_rows), ["hemisphere", "day_index"])


def masked_mean(value: Column, mask: Column) -> Column:
    """Mean over the rows where ``mask`` holds; NULL if there are none."""
    return F.avg(F.when(mask, value))


def correlation_of(covariance: Column, std_x: Column, std_y: Column) -> Column:
    """Pearson from population moments; NULL for a constant side (``corr`` would raise)."""
    return F.try_divide(covariance, std_x * std_y)


def household_years(usage: DataFrame) -> DataFrame:
    """Gather each household's days into two parallel arrays, in the one shuffle the features need.

    Needs one row per household and day (see :func:`daily_usage`), so an array
    holds a year at most. Partial lists would not shrink the data, hence rows
    are moved first and gathered where they land.
    """
    days = F.collect_list(F.struct("day_index", F.col("liters").cast("double").alias("liters")))
    return (
        usage.repartition(*[F.col(k) for k in KEYS])
        .groupBy(*KEYS)
        .agg(days.alias("days"))
        .select(*KEYS, F.col("days.day_index").alias("day_index"), F.col("days.liters").alias("liters"))
    )


def interpolated(ordered: Column, p: float) -> Column:
    """Linearly interpolated quantile of a sorted array; NULL if it is empty."""
    last = F.size(ordered) - 1
    x = last * F.lit(p)
    low = F.floor(x).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, last))
    return F.when(last >= 0, below + (above - below) * (x - low))


_FLAGS = ("is_dry", "is_weekend", "is_summer", "is_drought")


def flag_arrays(flags: DataFrame) -> DataFrame:
    """One row per hemisphere: temperature and flags of day ``i`` at position ``i``, NULL without weather."""
    names = ("temp", *_FLAGS)
    by_day = F.map_from_entries(F.collect_list(F.struct(F.col("day_index"), F.struct(*names))))
    days = F.sequence(F.lit(0), F.col("last_day"))
    year = F.transform(days, lambda d: F.col("by_day")[d])
    return (
        flags.groupBy("hemisphere")
        .agg(by_day.alias("by_day"), F.max("day_index").alias("last_day"), F.bool_or("any_drought").alias("any_drought"))
        .select("hemisphere", "any_drought", "last_day", year.alias("year"), (F.size("by_day") == F.size(days)).alias("gapless"))
        .select("hemisphere", "any_drought", "last_day", "gapless", *[F.col("year")[n].alias(n) for n in names])
    )


def known_only(ordered: Column) -> Column:
    """Known values of a sorted array, where NULLs come first and NaN last; a complete array is not touched."""
    complete = F.get(ordered, F.lit(0)).isNotNull() & ~F.isnan(F.get(ordered, F.size(ordered) - 1))
    return F.when(complete, ordered).otherwise(F.filter(ordered, lambda x: x.isNotNull() & ~F.isnan(x)))


def _with_weather(years: DataFrame) -> Column:
    """Readings of days that have weather; a year without gaps is not touched."""
    inside = (F.array_min("day_index") >= 0) & (F.array_max("day_index") <= F.col("last_day"))
    met = F.filter(F.arrays_zip("day_index", "liters"), lambda x: F.get("is_dry", x["day_index"]).isNotNull())
    return F.when(F.col("gapless") & inside, F.col("liters")).otherwise(F.transform(met, lambda x: x["liters"]))


def _cells(years: DataFrame, flags: DataFrame, keys: Sequence[str], flag_rows: int | None) -> tuple[DataFrame, dict[str, Column]]:
    """One row per reading with the flags of its day, and how the percentiles follow from it.

    Days without weather drop out of both. While the day table is small, percentiles are read off the sorted
    array in place and a day finds its flags by position; a larger one is joined.
    """
    wanted = ["any_drought", "liters", "temp", *_FLAGS]
    day, liters = F.get("day_index", F.col("i")).alias("day"), nan_to_null(F.col("value")).alias("liters")
    rows = flags.limit(DAY_TABLE_LIMIT + 1).count() if flag_rows is None else flag_rows
    if rows > DAY_TABLE_LIMIT:
        cells = years.select("*", F.posexplode_outer("liters").alias("i", "value")).select(*dict.fromkeys([*keys, "hemisphere"]), day, liters)
        cells = cells.join(flags.withColumnRenamed("day_index", "day"), ["hemisphere", "day"]).select(*dict.fromkeys([*keys, *wanted]))
        return cells, {name: F.percentile("liters", F.lit(p)) for name, p in _PERCENTILES.items()}
    placed = years.join(F.broadcast(flag_arrays(flags)), "hemisphere")
    ordered = placed.withColumn("ordered", F.sort_array(_with_weather(placed))).withColumn("ordered", known_only(F.col("ordered")))
    read = ordered.select(
        *keys, "any_drought", "day_index", "liters", "temp", *_FLAGS, *[interpolated(F.col("ordered"), p).alias(n) for n, p in _PERCENTILES.items()]
    )
    cells = (
        read.select("*", F.posexplode_outer("liters").alias("i", "value"))
        .select(*keys, *_PERCENTILES, "any_drought", liters, *[F.get(n, F.get("day_index", F.col("i"))).alias(n) for n in ("temp", *_FLAGS)])
        .where(F.col("is_dry").isNotNull())
    )
    return cells, {name: F.first(name) for name in _PERCENTILES}


_PERCENTILES = {"p25": 0.25, "p95": 0.95}


def year_statistics(
    years: DataFrame, flags: DataFrame, keys: Sequence[str] = KEYS, flag_rows: int | None = None
) -> DataFrame:
    """All per-household moments, masked means and percentiles over the days that have weather.

    ``years`` has one row per household with parallel arrays ``day_index`` and
    ``liters``. The days are unrolled inside the task and summed right there by a
    hash aggregate, without a join per reading as long as the day table is small
    enough to travel with the task. Both ways give the same result.
    """
    cells, percentiles = _cells(years, flags, keys, flag_rows)
    return cells.groupBy(*keys).agg(*_moments(), *[value.alias(name) for name, value in percentiles.items()])


def _moments() -> list[Column]:
    """Aggregates over readings with the flags of their day; all of them combine before a shuffle."""
    return [
        F.count("liters").alias("n_days"),
        F.avg("liters").alias("mean_usage"),
        F.stddev_pop("liters").alias("std_usage"),
        masked_mean(F.col("liters"), F.col("is_dry")).alias("dry_mean"),
        masked_mean(F.col("liters"), ~F.col("is_dry")).alias("wet_mean"),
        masked_mean(F.col("liters"), F.col("is_weekend")).alias("weekend_mean"),
        masked_mean(F.col("liters"), ~F.col("is_weekend")).alias("weekday_mean"),
        masked_mean(F.col("liters"), F.col("is_summer")).alias("summer_mean"),
        masked_mean(F.col("liters"), ~F.col("is_summer")).alias("winter_mean"),
        masked_mean(F.col("liters"), F.col("is_drought")).alias("drought_mean"),
        F.covar_pop("liters", "temp").alias("temp_covariance"),
        F.stddev_pop(F.when(F.col("liters").isNotNull(), F.col("temp"))).alias("temp_std"),
        # Constant within a household.
        F.first("any_drought").alias("any_drought"),
    ]


def moment_statistics(usage: DataFrame, flags: DataFrame, flag_rows: int | None = None) -> DataFrame:
    """:func:`year_statistics` without the percentiles: one partly summed row per household and task is shuffled."""
    cells = with_flags(usage.withColumn("liters", nan_to_null(F.col("liters").cast("double"))), flags, flag_rows)
    return cells.groupBy(*KEYS).agg(*_moments())


def usage_statistics(usage: DataFrame, flags: DataFrame, flag_rows: int | None = None) -> DataFrame:
    """:func:`year_statistics` of long usage; readings cross the network once."""
    return year_statistics(household_years(usage), flags, KEYS, flag_rows)


def feature_columns() -> dict[str, Column]:
    """The ten features as expressions over household traits and usage statistics."""
    mean = F.col("mean_usage")
    occupancy = F.greatest(F.col("occupancy_count").cast("double"), F.lit(1.0))
    efficiency = F.col("appliance_efficiency_score").cast("double")
    correlation = correlation_of(F.col("temp_covariance"), F.col("std_usage"), F.col("temp_std"))
    drought = guarded_ratio(F.col("drought_mean"), mean, 1.0)
    columns = {
        "log_per_capita_usage": F.log1p(mean / occupancy),
        "efficiency_penalty_ratio": F.lit(1.0) + (F.lit(1.0) - efficiency),
        "water_usage_cv": guarded_ratio(F.col("std_usage"), mean, 0.0),
        "dry_day_spike_factor": guarded_ratio(F.col("dry_mean"), F.col("wet_mean"), 1.0),
        "temp_sensitivity_corr": clip(nan_to(correlation, 0.0), MIN_TEMP_CORRELATION),
        "weekend_weekday_ratio": clip(
            guarded_ratio(F.col("weekend_mean"), F.col("weekday_mean"), 1.0), MIN_WEEKEND_RATIO
        ),
        "landscape_demand_index": landscape_coefficient(F.col("landscape_type")),
        "seasonal_amplitude_ratio": guarded_ratio(F.col("summer_mean"), F.col("winter_mean"), 1.0),
        "drought_responsiveness_index": F.when(F.col("any_drought"), drought).otherwise(F.lit(1.0)),
        "baseline_peak_ratio": guarded_ratio(F.col("p25"), F.col("p95"), 1.0),
    }
    return {name: columns[name] for name in FEATURES}


def features_from_statistics(household: DataFrame, statistics: DataFrame) -> DataFrame:
    """Join traits after the aggregation, when both sides hold one row per household."""
    return household.join(statistics, list(KEYS)).select(
        *KEYS, *[expr.alias(name) for name, expr in feature_columns().items()]
    )


def extract_features(
    household: DataFrame, usage: DataFrame, flags: DataFrame, flag_rows: int | None = None
) -> DataFrame:
    """Transform step: the ten unscaled features, with flags learned beforehand."""
    return features_from_statistics(household, usage_statistics(usage, flags, flag_rows))


def features_of(inputs: Inputs, flags: DataFrame | None = None) -> DataFrame:
    """The ten features of ``inputs``; day flags are learned from them unless given.

    If the inputs still carry the wide usage table, households are summed up
    where their row is read and only the sums meet the household keys.
    """
    flags = env_flags(inputs.environment) if flags is None else flags
    if inputs.matrix is None:
        return extract_features(inputs.household, inputs.usage, flags, inputs.environment_rows)
    statistics = year_statistics(inputs.matrix, flags, ("hemisphere", "row_number"), inputs.environment_rows)
    return features_from_statistics(
        inputs.household, statistics.join(inputs.positions, ["hemisphere", "row_number"])
    )
