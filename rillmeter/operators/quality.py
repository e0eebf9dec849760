"""Data-quality gates as rows of one table.

Every check yields ``(hemisphere, check_id, severity, observed, expected,
n_bad)``. ``error`` rows with ``n_bad > 0`` are violations; ``warn`` rows are
soft expectations and ``info`` rows are statistics to look at.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmeter.functions.hemispheres import LANDSCAPE_WEIGHTS, parameter
from rillmeter.functions.landscape import LANDSCAPE_TYPES
from rillmeter.operators.profile import category_shares
from rillmeter.schemas import ENVIRONMENT_SCHEMA, HOUSEHOLD_SCHEMA, KEYS, USAGE_SCHEMA, Inputs
from rillmeter.session import materialise

# Tolerance of soft checks and bounds of the inputs.
TOLERANCE = 0.15
OCCUPANCY_RANGE = (1, 8)
EFFICIENCY_RANGE = (0.15, 0.95)
RAIN_CAP_MM = 75.0
WET_FLOOR_MM = 0.1
FLOOR_SLACK = 1e-5


@dataclass(frozen=True)
class Expectations:
    """Sizes the inputs should have; ``households`` is per hemisphere, ``None`` skips the check."""

    households: int | None = None
    days: int = 365


class QualityError(ValueError):
    """Raised by :func:`require_clean`."""


def _number(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _check(check_id: str, severity: str, observed, expected: str | Column | None, n_bad) -> Column:
    text = expected if isinstance(expected, Column) else F.lit(expected)
    return F.struct(
        F.lit(check_id).alias("check_id"),
        F.lit(severity).alias("severity"),
        _number(observed).alias("observed"),
        text.cast("string").alias("expected"),
        F.coalesce((n_bad if isinstance(n_bad, Column) else F.lit(n_bad)).cast("long"), F.lit(0)).alias("n_bad"),
    )


def _rows(wide: DataFrame, checks: list[Column]) -> DataFrame:
    return wide.select("hemisphere", F.explode(F.array(*checks)).alias("c")).select("hemisphere", "c.*")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")


def off_target(observed: Column, target: Column) -> Column:
    """Soft check: the relative deviation exceeds the tolerance."""
    return _flag(F.abs(observed - target) / target > F.lit(TOLERANCE))


def check_household(household: DataFrame, expected: Expectations = Expectations()) -> DataFrame:
    """Row count, occupancy, ids and efficiency of the household table."""
    ids, occ, eff = F.col("household_id"), F.col("occupancy_count"), F.col("appliance_efficiency_score")
    wide = household.groupBy("hemisphere").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(ids).alias("n_ids"),
        F.count_if(ids.isNull() | (F.length(ids.cast("string")) == 0)).alias("empty_ids"),
        F.min(occ).alias("occ_min"),
        F.max(occ).alias("occ_max"),
        F.count_if(occ.isNull() | ~occ.between(*OCCUPANCY_RANGE)).alias("occ_bad"),
        F.avg(occ).alias("occ_mean"),
        F.stddev_pop(occ).alias("occ_std"),
        F.min(eff).alias("eff_min"),
        F.max(eff).alias("eff_max"),
        F.count_if((eff < F.lit(EFFICIENCY_RANGE[0]).cast(household.schema["appliance_efficiency_score"].dataType))
                   | (eff > F.lit(EFFICIENCY_RANGE[1]).cast(household.schema["appliance_efficiency_score"].dataType))
                   ).alias("eff_bad"),
        F.count_if(eff.isNull() | F.isnan(eff)).alias("eff_nan"),
        F.avg(eff).alias("eff_mean"),
        F.stddev_pop(eff).alias("eff_std"),
        F.count_distinct("landscape_type").alias("n_landscapes"),
    )
    occ_text, eff_text = "1..8", "0.15..0.95"
    occ_target, eff_target = parameter("occupancy_mean"), parameter("efficiency_mean")
    checks = [
        _check("Q3_occupancy_min", "error", F.col("occ_min"), occ_text, F.col("occ_bad")),
        _check("Q3_occupancy_max", "error", F.col("occ_max"), occ_text, F.col("occ_bad")),
        _check("Q10_unique_ids", "error", F.col("n_ids"), "one per row", F.col("n") - F.col("n_ids")),
        _check("Q10_non_empty_ids", "error", F.col("empty_ids"), "0", F.col("empty_ids")),
        _check("Q11_occupancy_mean", "warn", F.col("occ_mean"), "within 15%", off_target(F.col("occ_mean"), occ_target)),
        _check("Q12_efficiency_min", "error", F.col("eff_min"), eff_text, F.col("eff_bad")),
        _check("Q12_efficiency_max", "error", F.col("eff_max"), eff_text, F.col("eff_bad")),
        _check("Q12_efficiency_nan", "error", F.col("eff_nan"), "0", F.col("eff_nan")),
        _check("Q12_efficiency_mean", "warn", F.col("eff_mean"), "within 15%", off_target(F.col("eff_mean"), eff_target)),
        _check("Q15_occupancy_std", "info", F.col("occ_std"), None, 0),
        _check("Q15_efficiency_std", "info", F.col("eff_std"), None, 0),
        _check("Q15_landscape_labels", "info", F.col("n_landscapes"), None, 0),
    ]
    if expected.households is not None:
        size = F.lit(expected.households)
        for check_id in ("Q1_households", "Q10_id_count"):
            checks.append(_check(check_id, "error", F.col("n"), size, F.abs(F.col("n") - size)))
    return _rows(wide, checks)


def unknown_landscapes(household: DataFrame) -> DataFrame:
    """Labels outside the known list, with their row counts."""
    valid = household.sparkSession.createDataFrame([(x,) for x in LANDSCAPE_TYPES], "landscape_type STRING")
    observed = household.groupBy("hemisphere", "landscape_type").agg(F.count(F.lit(1)).alias("n"))
    return observed.join(valid, "landscape_type", "left_anti")


def check_landscape(household: DataFrame) -> DataFrame:
    """Unknown labels, label frequencies against their weights, and the modal label."""
    shares = category_shares(household, "landscape_type")
    known = F.col("landscape_type").isin(list(LANDSCAPE_TYPES))
    unknown = shares.groupBy("hemisphere").agg(
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"),
        *[F.coalesce(F.sum(F.when(F.col("landscape_type") == x, F.col("share"))), F.lit(0.0)).alias(x) for x in LANDSCAPE_TYPES],
        F.max(F.col("share")).alias("mode_share"),
    )
    checks = [
        _check("Q13_unknown_labels", "error", F.col("unknown"), "0", F.col("unknown")),
        _check("Q15_landscape_mode_share", "info", F.col("mode_share"), None, 0),
    ]
    for label in LANDSCAPE_TYPES:
        north, south = LANDSCAPE_WEIGHTS["north"][label], LANDSCAPE_WEIGHTS["south"][label]
        weight = F.when(F.col("hemisphere") == "north", F.lit(north)).otherwise(F.lit(south))
        checks.append(_check(f"Q13_share_{label}", "warn", F.col(label), weight, off_target(F.col(label), weight)))
    return _rows(unknown, checks)


def landscape_mode(household: DataFrame) -> DataFrame:
    """Most frequent landscape label per hemisphere, the alphabetically first of ties."""
    counts = household.groupBy("hemisphere", "landscape_type").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("hemisphere").agg(F.max("n").alias("n"))
    return counts.join(top, ["hemisphere", "n"]).groupBy("hemisphere").agg(F.min("landscape_type").alias("mode"))


def check_environment(environment: DataFrame, expected: Expectations = Expectations()) -> DataFrame:
    """Bounds, nulls, day sequence, rain rules and weather statistics of the day table.

    Without an explicit ``wet_dry_state`` column a day counts as wet when any
    rain fell.
    """
    temp, rain, day = F.col("daily_max_temp_celsius"), F.col("daily_rainfall_mm"), F.col("day_index")
    wet = F.col("wet_dry_state") == 1 if "wet_dry_state" in environment.columns else rain > 0
    columns = [c for c in environment.columns if c != "hemisphere"]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    wet_floor = F.lit(WET_FLOOR_MM).cast(environment.schema["daily_rainfall_mm"].dataType)
    wide = environment.groupBy("hemisphere").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(day).alias("n_days"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        nulls.alias("nulls"),
        F.min(temp).alias("temp_min"),
        F.max(temp).alias("temp_max"),
        F.count_if(temp < parameter("temp_lower")).alias("too_cold"),
        F.count_if(temp > parameter("temp_upper")).alias("too_warm"),
        F.min(rain).alias("rain_min"),
        F.max(rain).alias("rain_max"),
        F.count_if(rain < 0).alias("rain_negative"),
        F.count_if(rain > F.lit(RAIN_CAP_MM)).alias("rain_over"),
        F.min(F.when(wet, rain)).alias("wet_min"),
        F.count_if(wet & (rain < wet_floor)).alias("wet_below"),
        F.max(F.when(~wet, rain)).alias("dry_max"),
        F.count_if(~wet & (rain != 0)).alias("dry_rain"),
        F.avg(F.when(wet, 1.0).otherwise(0.0)).alias("wet_fraction"),
        F.avg(F.when(wet, rain)).alias("wet_mean"),
        F.avg(rain).alias("rain_mean"),
    )
    days = F.lit(expected.days)
    rows = F.abs(F.col("n") - days)
    last = expected.days - 1
    return _rows(
        wide,
        [
            _check("Q1_days", "error", F.col("n"), str(expected.days), rows),
            _check("Q5_temp_rows", "error", F.col("n"), str(expected.days), rows),
            _check("Q5_temp_min", "error", F.col("temp_min"), "hemisphere bound", F.col("too_cold")),
            _check("Q5_temp_max", "error", F.col("temp_max"), "hemisphere bound", F.col("too_warm")),
            _check("Q6_nulls", "error", F.col("nulls"), "0", F.col("nulls")),
            _check("Q6_first_day", "error", F.col("first_day"), "0", _flag(F.col("first_day") != 0)),
            _check("Q6_last_day", "error", F.col("last_day"), str(last), _flag(F.col("last_day") != last)),
            _check("Q6_distinct_days", "error", F.col("n_days"), "one row per day", F.col("n") - F.col("n_days")),
            _check("Q7_rain_rows", "error", F.col("n"), str(expected.days), rows),
            _check("Q7_rain_min", "error", F.col("rain_min"), ">= 0", F.col("rain_negative")),
            _check("Q7_rain_max", "error", F.col("rain_max"), "<= 75", F.col("rain_over")),
            _check("Q8_wet_floor", "error", F.col("wet_min"), ">= 0.1", F.col("wet_below")),
            _check("Q8_dry_exact", "error", F.col("dry_max"), "0", F.col("dry_rain")),
            _check("Q9_wet_fraction", "info", F.col("wet_fraction"), None, 0),
            _check("Q9_wet_mean", "info", F.col("wet_mean"), None, 0),
            _check("Q9_rain_mean", "info", F.col("rain_mean"), None, 0),
            _check("Q9_temp_min", "info", F.col("temp_min"), None, 0),
            _check("Q9_temp_max", "info", F.col("temp_max"), None, 0),
            _check("Q9_rain_min", "info", F.col("rain_min"), None, 0),
            _check("Q9_rain_max", "info", F.col("rain_max"), None, 0),
        ],
    )


def household_usage(usage: DataFrame) -> DataFrame:
    """What every usage gate needs, one row per household, from one scan.

    Readings are combined per household and day before they move, then per
    household, so repeated readings of one household do not pile up.
    """
    liters = F.col("liters").cast("double")
    finite = ~F.isnan(liters) & ~liters.isin(float("inf"), float("-inf"))
    value = F.when(finite, liters)
    sums = {
        "cells": F.count(F.lit(1)),
        "missing": F.count_if(liters.isNull()),
        "not_finite": F.count_if(~finite),
        "negative": F.count_if(liters < 0),
        "measured": F.count(value),
        "total": F.sum(value),
        "squares": F.sum(value * value),
    }
    per_day = usage.groupBy(*KEYS, "day_index").agg(
        *[x.alias(name) for name, x in sums.items()], F.min(value).alias("lowest"), F.max(value).alias("highest")
    )
    return per_day.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("days"),
        F.count("day_index").alias("known_days"),
        *[F.sum(name).alias(name) for name in sums],
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
    )


def check_usage(
    usage: DataFrame, household: DataFrame, expected: Expectations = Expectations(), per_household: DataFrame | None = None
) -> DataFrame:
    """Shape, sign, NaN/Inf, physiological floor and statistics of the usage table.

    ``per_household`` is :func:`household_usage`, if the caller has it already.
    The floor is checked on each household's smallest reading and counts households.
    """
    per_household = household_usage(usage) if per_household is None else per_household
    floor = F.col("occupancy_count") * parameter("intake_liters") - F.lit(FLOOR_SLACK)
    sums = ("days", "cells", "missing", "not_finite", "negative", "measured", "total", "squares")
    shape = (
        per_household.join(household.select(*KEYS, "occupancy_count"), list(KEYS), "left")
        .groupBy("hemisphere")
        .agg(
            F.count(F.lit(1)).alias("households"),
            *[F.sum(c).alias(c) for c in sums],
            F.min("lowest").alias("min"),
            F.max("highest").alias("max"),
            F.count_if(F.col("lowest") < floor).alias("below_floor"),
            F.count_if(F.col("days") != F.lit(expected.days)).alias("incomplete"),
        )
        .withColumn("mean", F.try_divide("total", "measured"))
        .withColumn("variance", F.try_divide("squares", "measured") - F.col("mean") * F.col("mean"))
        .withColumn("std", F.sqrt(F.when(F.col("variance") < 0, 0.0).otherwise(F.col("variance"))))
    )
    checks = [
        _check("Q1_usage_days", "error", F.col("days"), f"{expected.days} per household", F.col("incomplete")),
        _check("Q2_non_negative", "error", F.col("min"), ">= 0", F.col("negative")),
        _check("Q14_usage_shape", "error", F.col("cells"), "one cell per household and day", F.col("cells") - F.col("days")),
        _check("Q14_missing", "error", F.col("missing"), "0", F.col("missing")),
        _check("Q14_not_finite", "error", F.col("not_finite"), "0", F.col("not_finite")),
        _check("Q14_floor", "error", F.col("min"), ">= occupancy x intake", F.col("below_floor")),
        _check("Q15_usage_mean", "info", F.col("mean"), None, 0),
        _check("Q15_usage_std", "info", F.col("std"), None, 0),
        _check("Q15_usage_min", "info", F.col("min"), None, 0),
        _check("Q15_usage_max", "info", F.col("max"), None, 0),
    ]
    if expected.households is not None:
        size = F.lit(expected.households)
        checks.append(_check("Q1_usage_households", "error", F.col("households"), size, F.abs(F.col("households") - size)))
    return _rows(shape, checks)


def orphan_households(inputs: Inputs, metered: DataFrame | None = None) -> DataFrame:
    """Households without usage and usage without a household, with the side that has them.

    ``metered`` holds the distinct keys of usage, if the caller has them already.
    """
    metered = inputs.usage.select(*KEYS).distinct() if metered is None else metered
    unmetered = inputs.household.select(*KEYS).join(metered, list(KEYS), "left_anti")
    unknown = metered.join(inputs.household.select(*KEYS), list(KEYS), "left_anti")
    return unmetered.withColumn("missing_in", F.lit("usage")).unionByName(
        unknown.withColumn("missing_in", F.lit("household"))
    )


def check_integrity(inputs: Inputs, expected: Expectations = Expectations(), per_household: DataFrame | None = None) -> DataFrame:
    """Consistency across the three inputs; never raises. ``per_household`` as in :func:`check_usage`."""
    if per_household is None:
        per_household = materialise(household_usage(inputs.usage).select(*KEYS, "known_days"), "household-usage")
    households = inputs.household.groupBy("hemisphere").agg(F.count(F.lit(1)).alias("households"))
    metered = per_household.groupBy("hemisphere").agg(F.count(F.lit(1)).alias("metered"), F.max("known_days").alias("usage_days"))
    days = inputs.environment.groupBy("hemisphere").agg(F.count(F.lit(1)).alias("environment_days"))
    orphans = orphan_households(inputs, per_household.select(*KEYS)).groupBy("hemisphere").agg(F.count(F.lit(1)).alias("orphans"))
    wide = (
        households.join(metered, "hemisphere", "full")
        .join(days, "hemisphere", "full")
        .join(orphans, "hemisphere", "left")
        .fillna(0)
    )
    year = F.lit(expected.days)
    return _rows(
        wide,
        [
            _check("Q4_household_count", "error", F.col("metered"), F.col("households"), F.abs(F.col("metered") - F.col("households"))),
            _check("Q4_environment_days", "error", F.col("environment_days"), year, F.abs(F.col("environment_days") - year)),
            _check("Q4_usage_days", "error", F.col("usage_days"), year, F.abs(F.col("usage_days") - year)),
            _check("Q4_orphans", "error", F.col("orphans"), "0", F.col("orphans")),
        ],
    )


def integrity_messages(report: DataFrame) -> list[str]:
    """All violations as text; the report has a row per check and hemisphere."""
    bad = report.where((F.col("severity") == "error") & (F.col("n_bad") > 0)).orderBy("hemisphere", "check_id")
    return [
        f"{r['hemisphere']}: {r['check_id']} observed {r['observed']:g}, expected {r['expected']} ({r['n_bad']} bad)"
        for r in bad.collect()
    ]


def require_clean(report: DataFrame) -> None:
    """Strict mode: raise if any error row has bad rows behind it."""
    messages = integrity_messages(report)
    if messages:
        raise QualityError("; ".join(messages))


DECLARED = {
    "household": T.StructType([T.StructField("hemisphere", T.StringType()), *HOUSEHOLD_SCHEMA.fields]),
    "environment": T.StructType(
        [T.StructField("hemisphere", T.StringType()), T.StructField("day_index", T.IntegerType()), *ENVIRONMENT_SCHEMA.fields]
    ),
    "usage": USAGE_SCHEMA,
}


def check_types(table: str, df: DataFrame) -> DataFrame:
    """Declared against found column types; reads the schema only."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [
        (table, f.name, f.dataType.simpleString(), found.get(f.name), found.get(f.name) == f.dataType.simpleString())
        for f in DECLARED[table].fields
    ]
    return df.sparkSession.createDataFrame(
        rows, "table_name STRING, column STRING, declared STRING, found STRING, conforms BOOLEAN"
    )


def check_file_types(table: str, stored: DataFrame, parallel: int = 8) -> DataFrame:
    """Declared column types against the schema of every Parquet part file of a table read by ``spark.read.parquet``.

    ``(table_name, file, column, declared, found, conforms)``: a row per file and declared column; ``found`` is NULL
    where the file lacks the column. Columns that are folder names are in no file and are left out. Only footers are
    read, ``parallel`` files at a time; the driver holds a row per file and column.
    """
    spark = stored.sparkSession
    files = sorted(stored.inputFiles())
    with ThreadPoolExecutor(parallel) as pool:
        schemas = list(pool.map(lambda f: {c.name: c.dataType.simpleString() for c in spark.read.parquet(f).schema}, files))
    folders = {part.split("=")[0] for f in files for part in f.split("/")[:-1] if "=" in part}
    rows = [
        (table, file.rsplit("/", 1)[-1], c.name, c.dataType.simpleString(), found.get(c.name), found.get(c.name) == c.dataType.simpleString())
        for file, found in zip(files, schemas)
        for c in DECLARED[table].fields
        if c.name not in folders
    ]
    return spark.createDataFrame(
        rows, "table_name STRING, file STRING, column STRING, declared STRING, found STRING, conforms BOOLEAN"
    )


def check_inputs(inputs: Inputs, expected: Expectations = Expectations()) -> DataFrame:
    """All gates over the three inputs in one table; usage is scanned once."""
    per_household = materialise(household_usage(inputs.usage), "household-usage")
    return (
        check_household(inputs.household, expected)
        .unionByName(check_landscape(inputs.household))
        .unionByName(check_environment(inputs.environment, expected))
        .unionByName(check_usage(inputs.usage, inputs.household, expected, per_household))
        .unionByName(check_integrity(inputs, expected, per_household))
    )
