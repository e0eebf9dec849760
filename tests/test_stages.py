import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from fixtures import environment, household
from rillmeter.catalog import tables
from rillmeter.operators import quality
from rillmeter.operators.demand import day_deficits, expected_usage, year_arrays
from rillmeter.operators.scoring import CentroidTable, Scorer, load_scorer, score_profiles
from rillmeter.operators.selection import variance_filter
from rillmeter.operators.stages import DayFlags, VarianceMask, archetype_pipeline
from rillmeter.schemas import FINAL_FEATURES, KEYS, SCALED_ORDER


def ordered(df):
    return sorted(map(str, df.collect()))


def test_a_pipeline_is_saved_and_loaded_as_one_object(spark, sf_dir, tmp_path):
    features = tables.stored_features(spark, sf_dir)
    fitted = archetype_pipeline(k=3, starts=2).fit(features)
    fitted.write().overwrite().save(f"{tmp_path}/p")
    loaded = PipelineModel.load(f"{tmp_path}/p")
    assert [type(s).__name__ for s in loaded.stages] == ["ScalerModel", "VarianceMaskModel", "FinalFeatures", "ArchetypesModel"]
    assert ordered(loaded.transform(features)) == ordered(fitted.transform(features))
    assert ordered(loaded.stages[-1].table(spark)) == ordered(fitted.stages[-1].table(spark))
    assert loaded.stages[-1].table(spark).count() == 6
    # In another session, on rows of one hemisphere only.
    other = spark.newSession()
    some = other.createDataFrame(features.where("hemisphere = 'south'").toArrow().to_pylist(), features.schema)
    assert ordered(loaded.transform(some)) == ordered(fitted.transform(features).where("hemisphere = 'south'"))
    scaled = fitted.stages[0].transform(features)
    kept = variance_filter(scaled, SCALED_ORDER)
    assert fitted.stages[1].transform(scaled).columns == [*KEYS, *[c for c in SCALED_ORDER if any(c in names for names in kept.values())]]


def test_params_of_estimators_are_kept(spark, sf_dir, tmp_path):
    pipeline = archetype_pipeline(k=5, seed=7, starts=3)
    pipeline.write().overwrite().save(f"{tmp_path}/unfitted")
    stage = type(pipeline).load(f"{tmp_path}/unfitted").getStages()[-1]
    assert [stage.getOrDefault(p) for p in ("k", "seed", "starts")] == [5, 7, 3]
    scaled = spark.createDataFrame([("north", "a", 0.0, 1.0), ("north", "b", 1.0, 1.2)], "hemisphere STRING, household_id STRING, "
                                   + ", ".join(f"{c} DOUBLE" for c in SCALED_ORDER[:2]))
    assert VarianceMask(threshold=0.1).fit(scaled).transform(scaled).columns == [*KEYS, SCALED_ORDER[0]]


def test_day_flags_are_learned_once(spark, tmp_path):
    weather = environment(spark, [0.0] * 10 + [3.0] * 4)
    model = DayFlags().fit(weather)
    model.write().overwrite().save(f"{tmp_path}/days")
    loaded = type(model).load(f"{tmp_path}/days")
    readings = spark.createDataFrame([("north", "h", d, 1.0) for d in (0, 5, 13, 99)], "hemisphere STRING, household_id STRING, day_index INT, liters DOUBLE")
    rows = loaded.transform(readings).orderBy("day_index").collect()
    assert [(r["day_index"], r["is_dry"]) for r in rows] == [(0, True), (5, True), (13, False)]


@pytest.mark.parametrize("rows", [10, 100, 7_320])
def test_long_day_tables_need_no_join_by_hemisphere(spark, rows):
    homes = household(spark, [("north", f"n{i}", 1 + i % 4, 0.5, "turfgrass_dominant") for i in range(5)] + [("south", "s", 2, 0.9, "xeriscape_native")])
    days = environment(spark, [float(d % 3) for d in range(40)]).unionByName(environment(spark, [0.0] * 30, hemisphere="south"))
    want = ordered(expected_usage(homes, days))
    assert len(want) == 5 * 40 + 30
    found = expected_usage(homes, days, rows_per_part=rows)
    assert ordered(found) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = expected_usage(homes, days, rows_per_part=rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == max(-(-70 // rows), 1)
    parts = year_arrays(day_deficits(days), rows_per_part=rows)
    assert sum(r["n"] for p in parts for r in p.select(F.size("days").alias("n")).collect()) == 70


def test_any_number_of_centroids(spark):
    rows = [(h, i, [float((i * 7 + k * 3) % 11 - 5) + 0.01 * i for k in range(4)], f"a{i}") for h, n in (("north", 23), ("south", 9)) for i in range(n)]
    centroids = spark.createDataFrame(rows, "hemisphere STRING, cluster_id INT, centroid ARRAY<DOUBLE>, archetype STRING")
    points = [(h, f"{h}{i}", *[float((i * k) % 9 - 4) if (i + k) % 17 else None for k in (1, 2, 3, 5)]) for h in ("north", "south", "east") for i in range(40)]
    profiles = spark.createDataFrame(points, "hemisphere STRING, household_id STRING, " + ", ".join(f"{f} DOUBLE" for f in FINAL_FEATURES))
    bounds = spark.createDataFrame([(h, f, -2.0, 2.0) for h in ("north", "south") for f in FINAL_FEATURES], "hemisphere STRING, feature STRING, lower DOUBLE, upper DOUBLE")
    literals = load_scorer(centroids, bounds)
    assert isinstance(literals, Scorer)
    want = ordered(score_profiles(profiles, literals).where("hemisphere <> 'east'"))
    for most in (31, 10, 4):
        table = load_scorer(centroids, bounds, most_literals=most)
        assert isinstance(table, CentroidTable) and len(table.parts) == -(-23 // most)
        scored = score_profiles(profiles, table)
        assert ordered(scored.where("hemisphere <> 'east'")) == want
        assert scored.where("hemisphere = 'east' and (cluster_id is not null or is_anomaly is not null)").count() == 0


def test_a_part_file_of_another_type_is_named(spark, tmp_path):
    path = f"{tmp_path}/household"
    good = spark.createDataFrame([("a", 1, 0.5, "turfgrass_dominant")], "household_id STRING, occupancy_count SMALLINT, appliance_efficiency_score FLOAT, landscape_type STRING")
    good.write.parquet(f"{path}/hemisphere=north")
    good.withColumn("occupancy_count", F.lit(1)).drop("landscape_type").coalesce(1).write.parquet(f"{path}/hemisphere=south")
    checked = quality.check_file_types("household", spark.read.parquet(path)).where("not conforms").collect()
    assert sorted((r["column"], r["declared"], r["found"]) for r in checked) == [("landscape_type", "string", None), ("occupancy_count", "smallint", "int")]
    assert all(r["file"].endswith(".parquet") for r in checked) and len({r["file"] for r in checked}) == 1

