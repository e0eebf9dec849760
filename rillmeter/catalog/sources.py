"""S: sources, sinks and ingest. Every file read here was written from the panel by Spark."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from rillmeter.catalog import tables as t
from rillmeter.catalog.registry import query
from rillmeter.catalog.sql import long_of, r, with_tables
from rillmeter.functions.expressions import publish_float
from rillmeter.operators.scaling import fit_scaler, scale
from rillmeter.operators.selection import variance_table
from rillmeter.operators.stages import DayFlags, archetype_pipeline
from rillmeter.schemas import FEATURES, HEMISPHERES, KEYS, SCALED_ORDER
from rillmeter.session import scratch_path
from rillmeter.sources import layout

_KEYS = "hemisphere, CAST(household_id AS VARCHAR) AS household_id"


def _both(read):
    north, south = (read(h) for h in HEMISPHERES)
    return north.unionByName(south)


@query(
    "S1_household_csv",
    with_tables(
        "panel",
        f"SELECT {_KEYS}, CAST(occupancy_count AS SMALLINT) AS occupancy_count, "
        f"{r(appliance_efficiency_score='CAST(CAST(appliance_efficiency_score AS FLOAT) AS DOUBLE)')}, landscape_type FROM household",
    ),
)
def household_csv(spark, sf_dir):
    path = t.positional_copy(spark, sf_dir)
    return _both(lambda h: layout.read_household(spark, path, h))


_ENVIRONMENT = with_tables(
    "panel",
    "SELECT hemisphere, day_index, "
    + r(
        daily_max_temp_celsius="CAST(CAST(daily_max_temp_celsius AS FLOAT) AS DOUBLE)",
        daily_rainfall_mm="CAST(CAST(daily_rainfall_mm AS FLOAT) AS DOUBLE)",
    )
    + " FROM environment",
)


@query("S2_environment_csv", _ENVIRONMENT)
def environment_csv(spark, sf_dir):
    path = t.positional_copy(spark, sf_dir)
    return _both(lambda h: layout.read_environment(spark, path, h))


_DAY_CELLS = ", ".join(f"max(liters) FILTER (WHERE day_index = {d}) AS column_{d}" for d in range(365))


@query(
    "S3_usage_matrix",
    with_tables(
        "panel",
        "SELECT hemisphere, row_number() OVER (PARTITION BY hemisphere ORDER BY household_id) - 1 AS row_number, * EXCLUDE (hemisphere, household_id) "
        f"FROM (SELECT h.hemisphere, h.household_id, {_DAY_CELLS} FROM household h LEFT JOIN usage u "
        "ON h.hemisphere = u.hemisphere AND h.household_id = u.household_id GROUP BY 1, 2)",
    ),
)
def usage_matrix(spark, sf_dir):
    path = t.positional_copy(spark, sf_dir)
    return _both(lambda h: layout.read_usage_matrix(spark, path, h, numbered=True))


@query("S4_unpivot_usage", with_tables("panel", f"SELECT {_KEYS}, day_index, {r('liters')} FROM usage"))
def unpivot_usage(spark, sf_dir):
    return layout.load_inputs(spark, t.positional_copy(spark, sf_dir)).usage


_FEATURES = r(**{f: f"CAST(CAST({f} AS FLOAT) AS DOUBLE)" for f in FEATURES})


def _written_features(spark, sf_dir):
    path = scratch_path(spark, "keyed-features")
    layout.write_keyed(publish_float(t.features(spark, sf_dir), FEATURES), path)
    return path


@query(
    "S5_load_hemisphere",
    with_tables("features", f"SELECT hemisphere, household_id, {_FEATURES} FROM feat WHERE hemisphere = 'north'"),
)
def load_hemisphere(spark, sf_dir):
    df = layout.read_keyed(spark, _written_features(spark, sf_dir), "north")
    return df.select("hemisphere", "household_id", *FEATURES)


@query("S6_write_features", with_tables("features", f"SELECT hemisphere, household_id, {_FEATURES} FROM feat"))
def write_features(spark, sf_dir):
    return layout.read_keyed(spark, _written_features(spark, sf_dir)).select("hemisphere", "household_id", *FEATURES)


@query(
    "S7_write_csv",
    with_tables("panel", f"SELECT hemisphere, day_index, {r('daily_max_temp_celsius', 'daily_rainfall_mm')} FROM environment"),
)
def write_csv(spark, sf_dir):
    path = scratch_path(spark, "weather")
    layout.write_environment(t.panel(spark, sf_dir).environment, path)
    schema = "day_index INT, daily_max_temp_celsius DOUBLE, daily_rainfall_mm DOUBLE, hemisphere STRING"
    return spark.read.schema(schema).csv(f"{path}/environment", header=True)


@query("S8_write_usage", with_tables("panel", f"SELECT hemisphere, household_id, day_index, {r('liters')} FROM usage"))
def write_usage(spark, sf_dir):
    path = scratch_path(spark, "keyed-usage")
    layout.write_keyed(t.panel(spark, sf_dir).usage, path)
    return layout.read_keyed(spark, path).select("hemisphere", "household_id", "day_index", "liters")


@query(
    "S9_fitted_state",
    with_tables("scaled", f"SELECT hemisphere, \"column\", {r('center', 'scale')}, {r(digits=4, lambda_='\"lambda\"')} FROM params"),
)
def fitted_state(spark, sf_dir):
    unscaled = t.stored_features(spark, sf_dir)
    params = fit_scaler(unscaled)
    path = scratch_path(spark, "fitted")
    layout.save_fitted(path, t.flags(spark, sf_dir), params, variance_table(scale(unscaled, params), SCALED_ORDER))
    _, loaded, _ = layout.load_fitted(spark, path)
    return loaded.select("hemisphere", "column", "center", "scale", F.round("lambda", 4).alias("lambda_"))


@query(
    "S9_saved_pipeline",
    with_tables(
        "scaled",
        f"SELECT 'scaler' AS part, hemisphere, \"column\" AS item, {r(a='center', b='scale')}, {r(digits=4, c='\"lambda\"')} FROM params "
        "UNION ALL SELECT 'mask', hemisphere, \"column\", " + r(a="var_pop(value)") + ", CAST(var_pop(value) > 0.01 AS DOUBLE), NULL "
        f"FROM ({long_of('scaled', SCALED_ORDER)}) GROUP BY 1, 2, 3 "
        "UNION ALL SELECT 'days', hemisphere, CAST(day_index AS VARCHAR), " + r(a="temp") + ", CAST(dry_in_window AS DOUBLE), "
        "CAST(is_dry AS DOUBLE) + 2 * CAST(is_drought AS DOUBLE) + 4 * CAST(is_summer AS DOUBLE) + 8 * CAST(is_weekend AS DOUBLE) FROM flags "
        # Every household has the same cluster, archetype and distance before saving and after loading.
        "UNION ALL SELECT 'archetypes', hemisphere, 'households', count(*), count(*), count(*) FROM scaled GROUP BY hemisphere",
    ),
)
def saved_pipeline(spark, sf_dir):
    features = t.stored_features(spark, sf_dir)
    path = scratch_path(spark, "pipeline")
    fitted = archetype_pipeline().fit(features)
    fitted.write().save(f"{path}/features")
    PipelineModel([DayFlags().fit(t.panel(spark, sf_dir).environment)]).write().save(f"{path}/days")
    days, loaded = PipelineModel.load(f"{path}/days").stages[0], PipelineModel.load(f"{path}/features")
    scaler, mask = loaded.stages[:2]
    bit = lambda c, n: F.when(F.col(c), float(n)).otherwise(0.0)
    rows = lambda df, part, item, a, b, c: df.select(
        F.lit(part).alias("part"), "hemisphere", F.col(item).cast("string").alias("item"), *[x.cast("double").alias(n) for n, x in (("a", a), ("b", b), ("c", c))]
    )
    label = lambda model, name: model.transform(features).select(*KEYS, F.struct("cluster_id", "archetype", "min_distance").alias(name))
    both = label(fitted, "before").join(label(loaded, "after"), list(KEYS)).groupBy("hemisphere").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") == F.col("after")).alias("same"), F.count_if(F.col("after.archetype").isNotNull()).alias("named")
    )
    return (
        rows(scaler.table(spark), "scaler", "column", F.col("center"), F.col("scale"), F.round("lambda", 4))
        .union(rows(mask.table(spark), "mask", "column", F.col("variance"), bit("kept", 1), F.lit(None)))
        .union(rows(days.table(spark), "days", "day_index", F.col("temp"), F.col("dry_in_window"), bit("is_dry", 1) + bit("is_drought", 2) + bit("is_summer", 4) + bit("is_weekend", 8)))
        .union(rows(both.withColumn("item", F.lit("households")), "archetypes", "item", F.col("n"), F.col("same"), F.col("named")))
    )


@query(
    "S10_preview",
    with_tables(
        "panel",
        f"SELECT hemisphere, household_id, occupancy_count, {r('appliance_efficiency_score')}, landscape_type "
        "FROM household WHERE hemisphere = 'north' ORDER BY household_id LIMIT 10",
    ),
)
def preview(spark, sf_dir):
    household = t.panel(spark, sf_dir).household.where(F.col("hemisphere") == "north")
    return layout.preview(household.orderBy("household_id"))


@query(
    "S10_shape",
    with_tables(
        "panel",
        "SELECT 'household' AS table_name, count(*) AS n_rows, 5 AS n_columns, "
        "'hemisphere,household_id,occupancy_count,appliance_efficiency_score,landscape_type' AS column_names FROM household "
        "UNION ALL SELECT 'environment', count(*), 4, 'hemisphere,day_index,daily_max_temp_celsius,daily_rainfall_mm' FROM environment "
        "UNION ALL SELECT 'usage', count(*), 4, 'hemisphere,household_id,day_index,liters' FROM usage",
    ),
)
def shape(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    named = {"household": p.household, "environment": p.environment, "usage": p.usage}
    household, environment, usage = (layout.describe_shape(n, df) for n, df in named.items())
    return household.unionByName(environment).unionByName(usage)
