import pytest
from fixtures import inputs
from pyspark.sql import functions as F

from rillmeter.functions.expressions import rounded
from rillmeter.operators.features import features_of
from rillmeter.operators.quality import Expectations
from rillmeter.plans.clustering import train_clusters
from rillmeter.plans.feature_engineering import engineer, run_feature_engineering
from rillmeter.plans.scoring import score_households
from rillmeter.schemas import FEATURES, FINAL_FEATURES, SCALED_ORDER
from rillmeter.session import checkpoint_root, materialise, pin_small, small_side
from rillmeter.sources import layout
from rillmeter.sources.panel import load_panel


def test_rows_align_by_position_over_many_files(spark, tmp_path):
    n = 500
    household = spark.range(n).select(
        F.format_string("h%04d", "id").alias("household_id"), (1 + F.col("id") % 8).cast("short").alias("occupancy_count"),
        F.lit(2.0).cast("float").alias("appliance_efficiency_score"), F.lit("xeriscape_native").alias("landscape_type"),
    )
    household.repartitionByRange(7, "household_id").sortWithinPartitions("household_id").write.csv(str(tmp_path / "north_household.csv"), header=True)
    days = [(F.col("id") * 10 + d).cast("float").alias(f"column_{d}") for d in (0, 1, 10, 2)]
    spark.range(n).repartitionByRange(5, "id").sortWithinPartitions("id").select(*days).write.parquet(str(tmp_path / "north_water_usage.parquet"))
    (tmp_path / "north_environment.csv").write_text("daily_max_temp_celsius,daily_rainfall_mm\n" + "".join(f"{d},0.5\n" for d in range(11)))
    loaded = layout.load_inputs(spark, str(tmp_path), ["north"])
    rows = loaded.usage.collect()
    assert len(rows) == 4 * n
    assert all(r["liters"] == int(r["household_id"][1:]) * 10 + r["day_index"] for r in rows)
    assert loaded.household.agg(F.max("appliance_efficiency_score")).first()[0] == 1.0
    assert [tuple(r)[1:3] for r in loaded.environment.orderBy("day_index").collect()] == [(d, float(d)) for d in range(11)]
    long = features_of(inputs_only_long(loaded)).orderBy("household_id").collect()
    wide = features_of(loaded).orderBy("household_id").collect()
    assert [r["household_id"] for r in long] == [r["household_id"] for r in wide]
    for a, b in zip(long, wide):
        assert [a[f] for f in FEATURES] == pytest.approx([b[f] for f in FEATURES], nan_ok=True)


def inputs_only_long(loaded):
    from dataclasses import replace

    return replace(loaded, matrix=None, positions=None)


def test_bad_csv_fails(spark, tmp_path):
    (tmp_path / "north_household.csv").write_text("household_id,occupancy_count,appliance_efficiency_score,landscape_type\na,many,0.5,x\n")
    with pytest.raises(Exception):
        layout.read_household(spark, str(tmp_path), "north").collect()
    (tmp_path / "south_household.csv").write_text("household_id,landscape_type,appliance_efficiency_score,occupancy_count\na,x,0.5,3\n")
    with pytest.raises(Exception):
        layout.read_household(spark, str(tmp_path), "south").collect()


def test_whole_run_through_files(spark, sf_dir, tmp_path):
    panel = load_panel(spark, sf_dir)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    layout.write_positional(panel, source)
    done = run_feature_engineering(spark, source, out, Expectations(days=365), strict=False)
    n = panel.household.count()
    assert set(done.kept) == {"north", "south"}
    for name in ("features", "unscaled", "final"):
        table = layout.read_keyed(spark, f"{out}/{name}")
        assert table.count() == n and {t for c, t in table.dtypes if c not in ("hemisphere", "household_id")} == {"float"}
    assert set(FINAL_FEATURES) <= set(layout.read_keyed(spark, f"{out}/features").columns) <= {*SCALED_ORDER, "hemisphere", "household_id"}
    flags, params, mask = layout.load_fitted(spark, f"{out}/fitted")
    assert flags.count() == 730 and params.count() == 20 and mask.count() == 20
    again = features_of(layout.load_inputs(spark, source), flags)
    assert again.count() == n
    clustered = train_clusters(spark, out)
    labelled = layout.read_keyed(spark, f"{out}/final_with_clusters", "north")
    assert labelled.select("hemisphere").distinct().count() == 1 and labelled.where("archetype IS NULL").count() == 0
    models = layout.load_models(f"{out}/fitted")
    assert (models["south"].clusterCenters()[0] == clustered.models["south"].clusterCenters()[0]).all()
    scored = score_households(spark, out, layout.load_inputs(spark, source))
    both = scored.alias("s").join(clustered.assignments.alias("t"), ["hemisphere", "household_id"])
    assert both.where("s.cluster_id = t.cluster_id AND s.archetype = t.archetype AND abs(s.min_distance - t.min_distance) < 1e-6").count() == n
    assert scored.where("size(out_of_range) > 0").count() == 0
    pruned = labelled._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hemisphere" in pruned


def test_engineering_twice_gives_the_same(spark, sf_dir):
    first, second = (sorted(engineer(load_panel(spark, sf_dir)).final.collect()) for _ in range(2))
    assert first == second


def test_broadcast_only_below_the_limit(spark):
    table = spark.range(10)
    plans = [small_side(table, limit)._jdf.queryExecution().analyzed().toString() for limit in (9, 10)]
    assert ["broadcast" in p for p in plans] == [False, True]
    assert "LocalRelation" in pin_small(table, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert pin_small(table, 9) is table


def test_materialised_tables_lie_in_the_checkpoint_folder(spark):
    stored = materialise(spark.range(5), "five")
    assert stored.count() == 5 and checkpoint_root(spark) in stored.inputFiles()[0]


def test_usage_matrix_keeps_gaps(spark):
    panel = inputs(spark, {"a": [1, None, 3]}, [0, 0, 0])
    row = layout.usage_matrix(panel.usage.where("liters IS NOT NULL"), 3).first()
    assert (row["column_0"], row["column_1"], row["column_2"]) == (1.0, None, 3.0)


def test_row_numbers_survive_changed_parallelism(spark, tmp_path):
    from rillmeter.sources.layout import _numbered_csv

    path = tmp_path / "rows.csv"
    path.write_text("v\n" + "".join(f"{i}\n" for i in range(40_000)))
    settings = {"spark.sql.files.openCostInBytes": "1000", "spark.sql.leafNodeDefaultParallelism": "4"}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        frame = _numbered_csv(spark.read.schema("v INT").csv(str(path), header=True))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "7")
        rows = frame.collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert len(rows) == 40_000 and all(r["v"] == r["row_number"] for r in rows)


def test_readings_are_moved_once_to_become_wide(spark):
    """Widened before they are moved, a year for every household and task would be sent."""
    panel = inputs(spark, {"a": [1, None, 3], "b": [4, 5, 6]}, [0, 0, 0])
    wide = layout.usage_matrix(panel.usage, 3)
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r)[1:] for r in wide.collect()) == [("a", 1.0, None, 3.0), ("b", 4.0, 5.0, 6.0)]


def test_rounding_keeps_what_is_no_number(spark):
    values = [-0.0, -1e-9, 0.0, 1.2345675, -2.5e-6, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x DOUBLE").select(rounded(F.col("x"))).collect()]
    assert [str(x) for x in got] == ["0.0", "0.0", "0.0", "1.234568", "-3e-06", "inf", "None"]
