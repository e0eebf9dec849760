import numpy as np
import pytest
from fixtures import ENVIRONMENT, HOUSEHOLD, USAGE, inputs
from pyspark.sql import functions as F

from rillmeter.operators import quality as q
from rillmeter.schemas import Inputs
from rillmeter.session import materialise

GOOD = q.Expectations(households=2, days=14)


def clean(spark):
    panel = inputs(spark, {"a": [50.0] * 14, "b": [80.0] * 14}, [0, 0.5] * 7)
    return panel


def bad(report):
    return {r["check_id"] for r in report.collect() if r["n_bad"] > 0 and r["severity"] == "error"}


def test_clean_inputs_pass(spark):
    report = q.check_inputs(clean(spark), GOOD)
    assert bad(report) == set()
    q.require_clean(report)


def test_household_gates(spark):
    rows = [("north", "a", 0, 0.1, "gravel"), ("north", "a", 9, float("nan"), "xeriscape_native"), ("north", "", 3, 0.99, "food_homegarden")]
    household = spark.createDataFrame(rows, HOUSEHOLD)
    found = bad(q.check_household(household, GOOD).unionByName(q.check_landscape(household)))
    assert found == {
        "Q1_households", "Q3_occupancy_min", "Q3_occupancy_max", "Q10_unique_ids", "Q10_non_empty_ids", "Q10_id_count",
        "Q12_efficiency_min", "Q12_efficiency_max", "Q12_efficiency_nan", "Q13_unknown_labels",
    }
    assert [r["landscape_type"] for r in q.unknown_landscapes(household).collect()] == ["gravel"]


def test_environment_gates(spark):
    rows = [("north", 1, 3.0, -1.0), ("north", 2, 40.0, 90.0), ("north", 2, None, 0.05)]
    found = bad(q.check_environment(spark.createDataFrame(rows, ENVIRONMENT), GOOD))
    assert found == {
        "Q1_days", "Q5_temp_rows", "Q5_temp_min", "Q5_temp_max", "Q6_nulls", "Q6_first_day", "Q6_last_day", "Q6_distinct_days",
        "Q7_rain_rows", "Q7_rain_min", "Q7_rain_max", "Q8_wet_floor", "Q8_dry_exact",
    }


def test_explicit_wet_state(spark):
    rows = [("north", 0, 10.0, 0.0, 1), ("north", 1, 10.0, 2.0, 0)]
    environment = spark.createDataFrame(rows, ENVIRONMENT + ", wet_dry_state INT")
    assert {"Q8_wet_floor", "Q8_dry_exact"} <= bad(q.check_environment(environment, q.Expectations(days=2)))


def test_usage_gates(spark):
    panel = clean(spark)
    extra = [("north", "a", 0, -2.0), ("north", "a", 1, float("nan")), ("north", "b", 2, float("inf")), ("north", "b", 3, 1.0), ("north", "b", 3, None)]
    usage = panel.usage.where("day_index > 3").unionByName(spark.createDataFrame(extra, USAGE))
    found = bad(q.check_usage(usage, panel.household, q.Expectations(households=3, days=14)))
    assert found == {"Q1_usage_days", "Q1_usage_households", "Q2_non_negative", "Q14_usage_shape", "Q14_missing", "Q14_not_finite", "Q14_floor"}


def test_orphans_on_both_sides(spark):
    panel = clean(spark)
    usage = panel.usage.withColumn("household_id", F.when(F.col("household_id") == "b", "c").otherwise(F.col("household_id")))
    broken = Inputs(panel.household, panel.environment, usage)
    assert sorted((r["household_id"], r["missing_in"]) for r in q.orphan_households(broken).collect()) == [("b", "usage"), ("c", "household")]
    report = q.check_integrity(broken, GOOD)
    assert bad(report) == {"Q4_orphans"}
    assert len(q.integrity_messages(report)) == 1
    with pytest.raises(q.QualityError, match="Q4_orphans"):
        q.require_clean(report)


def test_soft_checks_warn(spark):
    rows = [("north", str(i), 8, 0.2, "food_homegarden") for i in range(4)]
    household = spark.createDataFrame(rows, HOUSEHOLD)
    report = q.check_household(household).unionByName(q.check_landscape(household))
    warned = {r["check_id"] for r in report.collect() if r["severity"] == "warn" and r["n_bad"] > 0}
    assert {"Q11_occupancy_mean", "Q12_efficiency_mean", "Q13_share_food_homegarden", "Q13_share_turfgrass_dominant"} <= warned
    assert bad(report) == set()


def test_types(spark):
    rows = {r["column"]: r["conforms"] for r in q.check_types("household", clean(spark).household).collect()}
    assert rows == {"hemisphere": True, "household_id": True, "occupancy_count": False, "appliance_efficiency_score": False, "landscape_type": True}


def test_usage_statistics_from_sums(spark):
    panel = inputs(spark, {"a": [50.0] * 14, "b": [80.0, float("nan"), None] + [90.0] * 11}, [0, 0.5] * 7)
    found = {r["check_id"]: r["observed"] for r in q.check_usage(panel.usage, panel.household, GOOD).collect()}
    values = np.array([50.0] * 14 + [80.0] + [90.0] * 11)
    assert found["Q15_usage_mean"] == pytest.approx(values.mean()) and found["Q15_usage_std"] == pytest.approx(values.std())
    assert (found["Q15_usage_min"], found["Q15_usage_max"]) == (50.0, 90.0)


def test_usage_without_a_measured_value(spark):
    panel = inputs(spark, {"a": [None] * 14}, [0, 0.5] * 7)
    found = {r["check_id"]: r["observed"] for r in q.check_usage(panel.usage, panel.household, GOOD).collect()}
    assert found["Q15_usage_mean"] is None and found["Q15_usage_std"] is None


def test_all_gates_start_from_one_stored_pass_over_usage(spark):
    panel = clean(spark)
    report = q.check_inputs(Inputs(panel.household, panel.environment, materialise(panel.usage, "readings")))
    read = "".join(report.inputFiles())
    assert "/household-usage-" in read and "/readings-" not in read
