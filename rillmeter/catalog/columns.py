"""P: projections, filters, predicates and scalar expressions."""

from pyspark.sql import functions as F

from rillmeter.catalog import tables as t
from rillmeter.catalog.registry import query
from rillmeter.catalog.sql import COEFFICIENT, r, with_tables
from rillmeter.functions import calendar
from rillmeter.functions import expressions as e
from rillmeter.functions.landscape import LANDSCAPE_TYPES, landscape_coefficient
from rillmeter.operators.demand import rain_probability, seasonal_baseline
from rillmeter.operators.selection import reduce_collinear
from rillmeter.schemas import FEATURES, FINAL_FEATURES, KEYS

_HID = "hemisphere, household_id"


@query(
    "P1_declared_types",
    with_tables(
        "panel",
        "SELECT CAST(household_id AS VARCHAR) AS household_id, CAST(occupancy_count AS SMALLINT) AS occupancy_count, "
        f"{r(appliance_efficiency_score='CAST(CAST(appliance_efficiency_score AS FLOAT) AS DOUBLE)')}, landscape_type FROM household",
    ),
)
def declared_types(spark, sf_dir):
    types = {
        "household_id": "string",
        "occupancy_count": "smallint",
        "appliance_efficiency_score": "float",
        "landscape_type": "string",
    }
    return e.cast_to(t.panel(spark, sf_dir).household, types)


@query("P2_select", with_tables("features", f"SELECT {_HID}, {r(*FINAL_FEATURES)} FROM feat"))
def select_columns(spark, sf_dir):
    return t.features(spark, sf_dir).select(*KEYS, *FINAL_FEATURES)


@query("P3_drop_collinear", with_tables("features", f"SELECT {_HID}, {r(*[f for f in FEATURES if f in FINAL_FEATURES])} FROM feat"))
def drop_collinear(spark, sf_dir):
    return reduce_collinear(t.features(spark, sf_dir))


@query("P4_distinct_names", with_tables("panel", "SELECT hemisphere, household_id, occupancy_count, landscape_type FROM household"))
def distinct_names(spark, sf_dir):
    numeric, encoded = [*KEYS, "occupancy_count"], [*KEYS, "occupancy_count", "landscape_type"]
    return e.select_distinct_names(t.panel(spark, sf_dir).household, numeric + encoded)


@query("P5_strip_prefixes", with_tables("features", f"SELECT {_HID}, {r('log_per_capita_usage', 'water_usage_cv')} FROM feat"))
def strip_prefixes(spark, sf_dir):
    named = t.features(spark, sf_dir).select(
        *KEYS,
        F.col("log_per_capita_usage").alias("robust__log_per_capita_usage"),
        F.col("water_usage_cv").alias("power__water_usage_cv"),
    )
    return e.strip_prefixes(named)


@query(
    "P6_clip",
    with_tables(
        "panel",
        "SELECT hemisphere, day_index, "
        + r(
            both="least(greatest(daily_max_temp_celsius, 10), 20)",
            lower_only="greatest(daily_max_temp_celsius, 12)",
            upper_only="least(daily_rainfall_mm, 5)",
        )
        + " FROM environment",
    ),
)
def clip(spark, sf_dir):
    temp, rain = F.col("daily_max_temp_celsius"), F.col("daily_rainfall_mm")
    return t.panel(spark, sf_dir).environment.select(
        "hemisphere", "day_index",
        e.clip(temp, 10.0, 20.0).alias("both"),
        e.clip(temp, lower=12.0).alias("lower_only"),
        e.clip(rain, upper=5.0).alias("upper_only"),
    )


@query(
    "P7_guarded_ratio",
    with_tables(
        "panel",
        "SELECT hemisphere, day_index, "
        + r(
            default_one="CASE WHEN daily_rainfall_mm > 0 THEN daily_max_temp_celsius / daily_rainfall_mm ELSE 1 END",
            default_zero="CASE WHEN daily_rainfall_mm > 0 THEN daily_max_temp_celsius / daily_rainfall_mm ELSE 0 END",
        )
        + " FROM environment",
    ),
)
def guarded_ratio(spark, sf_dir):
    temp, rain = F.col("daily_max_temp_celsius"), F.col("daily_rainfall_mm")
    return t.panel(spark, sf_dir).environment.select(
        "hemisphere", "day_index",
        e.guarded_ratio(temp, rain, 1.0).alias("default_one"),
        e.guarded_ratio(temp, rain, 0.0).alias("default_zero"),
    )


@query(
    "P8_nan_to_default",
    with_tables(
        "panel",
        "SELECT hemisphere, day_index, "
        + r(root="CASE WHEN daily_max_temp_celsius >= 14 THEN sqrt(daily_max_temp_celsius - 14) ELSE 0 END")
        + " FROM environment",
    ),
)
def nan_to_default(spark, sf_dir):
    root = F.sqrt(F.col("daily_max_temp_celsius") - 14)
    return t.panel(spark, sf_dir).environment.select("hemisphere", "day_index", e.nan_to(root, 0.0).alias("root"))


@query("P9_log1p", with_tables("panel", f"SELECT hemisphere, household_id, day_index, {r(log_liters='ln(1 + liters)')} FROM usage"))
def log1p(spark, sf_dir):
    return t.panel(spark, sf_dir).usage.select(*KEYS, "day_index", F.log1p("liters").alias("log_liters"))


@query("P10_landscape_coefficient", with_tables("panel", f"SELECT {_HID}, {r(coefficient=COEFFICIENT)} FROM household"))
def coefficient(spark, sf_dir):
    return t.panel(spark, sf_dir).household.select(*KEYS, landscape_coefficient(F.col("landscape_type")).alias("coefficient"))


@query("P11_weekend", with_tables("flags", "SELECT hemisphere, day_index, is_weekend, NOT is_weekend AS is_weekday FROM flags"))
def weekend(spark, sf_dir):
    is_weekend = calendar.is_weekend(F.col("day_index"))
    return t.panel(spark, sf_dir).environment.select(
        "hemisphere", "day_index", is_weekend.alias("is_weekend"), (~is_weekend).alias("is_weekday")
    )


@query("P12_season", with_tables("flags", "SELECT hemisphere, day_index, is_summer, NOT is_summer AS is_winter FROM flags"))
def season(spark, sf_dir):
    summer = calendar.is_summer(F.col("hemisphere"), F.col("day_index"))
    return t.panel(spark, sf_dir).environment.select(
        "hemisphere", "day_index", summer.alias("is_summer"), (~summer).alias("is_winter")
    )


@query("P13_dry", with_tables("flags", "SELECT hemisphere, day_index, is_dry, NOT is_dry AS is_wet FROM flags"))
def dry(spark, sf_dir):
    is_dry = calendar.is_dry(F.col("daily_rainfall_mm"))
    return t.panel(spark, sf_dir).environment.select("hemisphere", "day_index", is_dry.alias("is_dry"), (~is_dry).alias("is_wet"))


@query(
    "P14_row_filter",
    with_tables("panel", f"SELECT hemisphere, day_index, {r('daily_rainfall_mm')} FROM environment WHERE daily_rainfall_mm > 0"),
)
def row_filter(spark, sf_dir):
    wet = t.panel(spark, sf_dir).environment.where(F.col("daily_rainfall_mm") > 0)
    return wet.select("hemisphere", "day_index", "daily_rainfall_mm")


@query(
    "P15_round",
    with_tables(
        "demand",
        "SELECT hemisphere, day_index, "
        + r(
            base_seasonal_temp_celsius="round_even(temp_mean + amp * sin(2 * pi() / 365 * (day_index - phase)), 2)",
            rain_probability="round_even(1 / (1 + exp(k * (daily_max_temp_celsius - t0))), 4)",
        )
        + " FROM environment JOIN params_d USING (hemisphere)",
    ),
)
def round_decimals(spark, sf_dir):
    both = rain_probability(seasonal_baseline(t.panel(spark, sf_dir).environment))
    return both.select("hemisphere", "day_index", "base_seasonal_temp_celsius", "rain_probability")


_LEVELS = sorted(LANDSCAPE_TYPES)[1:]


@query(
    "P16_one_hot",
    with_tables(
        "panel",
        f"SELECT {_HID}, " + ", ".join(f"CASE WHEN landscape_type = '{x}' THEN 1 ELSE 0 END AS landscape_type_{x}" for x in _LEVELS) + " FROM household",
    ),
)
def one_hot(spark, sf_dir):
    encoded = e.one_hot(t.panel(spark, sf_dir).household, "landscape_type", LANDSCAPE_TYPES)
    return encoded.select(*KEYS, *[f"landscape_type_{x}" for x in _LEVELS])


@query(
    "P17_float32",
    with_tables("features", f"SELECT {_HID}, {r(**{f: f'CAST(CAST({f} AS FLOAT) AS DOUBLE)' for f in FEATURES})} FROM feat"),
)
def float32(spark, sf_dir):
    return e.publish_float(t.features(spark, sf_dir), FEATURES)


@query(
    "P18_append_columns",
    with_tables(
        "panel",
        "SELECT hemisphere, household_id, occupancy_count, "
        + r("appliance_efficiency_score", penalty="2 - appliance_efficiency_score")
        + f", landscape_type, {r(coefficient=COEFFICIENT)} FROM household",
    ),
)
def append_columns(spark, sf_dir):
    return t.panel(spark, sf_dir).household.withColumns(
        {
            "penalty": F.lit(2.0) - F.col("appliance_efficiency_score"),
            "coefficient": landscape_coefficient(F.col("landscape_type")),
        }
    )
