"""J, W and O: joins, window, ordering and set operations."""

from pyspark.sql import functions as F

from rillmeter.catalog import tables as t
from rillmeter.catalog.registry import query
from rillmeter.catalog.sql import r, with_tables
from rillmeter.functions.expressions import one_hot
from rillmeter.functions.landscape import LANDSCAPE_TYPES
from rillmeter.operators import demand, quality
from rillmeter.operators.features import with_flags
from rillmeter.operators.profile import traits_with_means
from rillmeter.operators.sampling import sample_per_group
from rillmeter.operators.scoring import score_profiles
from rillmeter.schemas import FINAL_FEATURES, HEMISPHERES, KEYS
from rillmeter.sources import layout

_HID = "hemisphere, household_id"


@query(
    "J1_temperature_rainfall",
    with_tables("panel", f"SELECT hemisphere, day_index, {r('daily_max_temp_celsius', 'daily_rainfall_mm')} FROM environment"),
)
def temperature_rainfall(spark, sf_dir):
    environment = t.panel(spark, sf_dir).environment
    temp = environment.select("hemisphere", "day_index", "daily_max_temp_celsius")
    rain = environment.select("hemisphere", "day_index", "daily_rainfall_mm")
    return temp.join(rain, ["hemisphere", "day_index"])


@query(
    "J2_household_usage",
    with_tables(
        "panel",
        "SELECT h.hemisphere, CAST(h.household_id AS VARCHAR) AS household_id, CAST(occupancy_count AS SMALLINT) AS occupancy_count, "
        "landscape_type, count(liters) AS n_days, "
        + r(total_liters="sum(liters)")
        + " FROM household h JOIN usage u ON h.hemisphere = u.hemisphere AND h.household_id = u.household_id GROUP BY 1, 2, 3, 4",
    ),
)
def household_usage(spark, sf_dir):
    inputs = layout.load_inputs(spark, t.positional_copy(spark, sf_dir))
    return (
        inputs.household.join(inputs.usage, list(KEYS))
        .groupBy(*KEYS, "occupancy_count", "landscape_type")
        .agg(F.count("liters").alias("n_days"), F.sum("liters").alias("total_liters"))
    )


@query(
    "J3_usage_environment",
    with_tables(
        "flags",
        f"SELECT u.hemisphere, household_id, u.day_index, {r('liters', 'temp')}, is_dry, is_weekend, is_summer, is_drought "
        "FROM usage u JOIN flags f ON u.hemisphere = f.hemisphere AND u.day_index = f.day_index",
    ),
)
def usage_environment(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    joined = with_flags(p.usage, t.flags(spark, sf_dir), p.environment_rows)
    return joined.select(*KEYS, "day_index", "liters", "temp", "is_dry", "is_weekend", "is_summer", "is_drought")


@query(
    "J4_unscaled_clusters",
    with_tables(
        "scored",
        f"SELECT f.hemisphere, f.household_id, {r(*FINAL_FEATURES)}, cluster_id "
        "FROM feat f JOIN scored s ON f.hemisphere = s.hemisphere AND f.household_id = s.household_id",
    ),
)
def unscaled_clusters(spark, sf_dir):
    final = t.stored_final(spark, sf_dir)
    labels = score_profiles(final, t.class_scorer(spark, sf_dir, final)).select(*KEYS, "cluster_id")
    return t.features(spark, sf_dir).select(*KEYS, *FINAL_FEATURES).join(labels, list(KEYS))


_DUMMIES = sorted(LANDSCAPE_TYPES)[1:]


@query(
    "J5_dummies_and_numbers",
    with_tables(
        "panel",
        f"SELECT {_HID}, occupancy_count, {r('appliance_efficiency_score')}, "
        + ", ".join(f"CASE WHEN landscape_type = '{x}' THEN 1 ELSE 0 END AS landscape_type_{x}" for x in _DUMMIES)
        + " FROM household",
    ),
)
def dummies_and_numbers(spark, sf_dir):
    encoded = one_hot(t.panel(spark, sf_dir).household, "landscape_type", LANDSCAPE_TYPES)
    return encoded.drop("landscape_type")


@query(
    "J6_household_days",
    with_tables("demand", f"SELECT {_HID}, day_index, {r('indoor_liters', 'outdoor_liters', 'expected_liters')} FROM expected"),
)
def household_days(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    return demand.expected_usage(p.household, p.environment, p.environment_rows)


@query(
    "J7_orphans",
    with_tables(
        "panel",
        f"SELECT {_HID}, 'usage' AS missing_in FROM (SELECT {_HID} FROM household EXCEPT SELECT {_HID} FROM usage) "
        f"UNION ALL SELECT {_HID}, 'household' FROM (SELECT {_HID} FROM usage EXCEPT SELECT {_HID} FROM household)",
    ),
)
def orphans(spark, sf_dir):
    return quality.orphan_households(t.panel(spark, sf_dir))


@query("W1_drought_window", with_tables("flags", "SELECT hemisphere, day_index, is_dry, dry_in_window, is_drought, any_drought FROM flags"))
def drought_window(spark, sf_dir):
    return t.flags(spark, sf_dir).select("hemisphere", "day_index", "is_dry", "dry_in_window", "is_drought", "any_drought")


@query(
    "O1_extreme_centroids",
    with_tables(
        "scored",
        "SELECT hemisphere, arg_min(cluster_id, log_per_capita_usage) AS lowest, arg_max(cluster_id, log_per_capita_usage) AS highest "
        "FROM centroids GROUP BY 1",
    ),
)
def extreme_centroids(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    centroids = t.class_centroids(t.scaled(spark, sf_dir), p.household)
    usage = F.col("centroid")[0]
    return centroids.groupBy("hemisphere").agg(
        F.min_by("cluster_id", usage).alias("lowest"), F.max_by("cluster_id", usage).alias("highest")
    )


@query("O2_nearest_centroid", with_tables("scored", f"SELECT {_HID}, cluster_id FROM scored"))
def nearest_centroid(spark, sf_dir):
    final = t.stored_final(spark, sf_dir)
    return score_profiles(final, t.class_scorer(spark, sf_dir, final)).select(*KEYS, "cluster_id")


@query(
    "O3_unknown_labels",
    "SELECT hemisphere, landscape_type, n FROM (SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'north' ELSE 'south' END AS hemisphere, "
    "lower(r_name) AS landscape_type, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) WHERE landscape_type NOT IN "
    "('turfgrass_dominant', 'hardscape_dominant', 'container_balcony', 'xeriscape_native', 'food_homegarden')",
)
def unknown_labels(spark, sf_dir):
    # Region names are labels the demand model does not know.
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    labelled = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.when(F.col("s_nationkey") % 2 == 0, "north").otherwise("south").alias("hemisphere"),
            F.lower("r_name").alias("landscape_type"),
        )
    )
    return quality.unknown_landscapes(labelled).select("hemisphere", "landscape_type", "n")


@query(
    "O4_random_sample",
    with_tables(
        "panel",
        f"SELECT {_HID} FROM household QUALIFY row_number() OVER (PARTITION BY hemisphere "
        "ORDER BY md5(concat_ws('|', '42', hemisphere, CAST(household_id AS VARCHAR)))) <= 20",
    ),
)
def random_sample(spark, sf_dir):
    household = t.panel(spark, sf_dir).household.select(*KEYS)
    return sample_per_group(household, "hemisphere", HEMISPHERES, KEYS, 20)


@query(
    "O5_first_last_day",
    with_tables(
        "panel",
        "SELECT hemisphere, min(day_index) AS first_day, max(day_index) AS last_day, count(DISTINCT day_index) AS n_days, "
        + r(
            first_temp="arg_min(daily_max_temp_celsius, day_index)",
            last_temp="arg_max(daily_max_temp_celsius, day_index)",
        )
        + " FROM environment GROUP BY 1",
    ),
)
def first_last_day(spark, sf_dir):
    return t.panel(spark, sf_dir).environment.groupBy("hemisphere").agg(
        F.min("day_index").alias("first_day"),
        F.max("day_index").alias("last_day"),
        F.count_distinct("day_index").alias("n_days"),
        F.min_by("daily_max_temp_celsius", "day_index").alias("first_temp"),
        F.max_by("daily_max_temp_celsius", "day_index").alias("last_temp"),
    )


@query(
    "O6_cluster_order",
    with_tables("scored", "SELECT hemisphere, cluster_id, count(*) AS n FROM scored GROUP BY 1, 2 ORDER BY hemisphere, cluster_id"),
)
def cluster_order(spark, sf_dir):
    final = t.stored_final(spark, sf_dir)
    scored = score_profiles(final, t.class_scorer(spark, sf_dir, final))
    return scored.groupBy("hemisphere", "cluster_id").agg(F.count(F.lit(1)).alias("n")).orderBy("hemisphere", "cluster_id")


@query(
    "J2_traits_and_means",
    with_tables(
        "stats",
        f"SELECT h.hemisphere, h.household_id, occupancy_count, {r('appliance_efficiency_score')}, landscape_type, "
        + r(mean_daily_water_usage="mean_usage", weekend_mean="weekend_mean", weekday_mean="weekday_mean")
        + " FROM household h JOIN stats s ON h.hemisphere = s.hemisphere AND h.household_id = s.household_id",
    ),
)
def traits_and_means(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    return traits_with_means(p.household, p.usage)
