from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmeter.functions.power import yeo_johnson
from rillmeter.operators.scaling import fit_lambdas, fit_power, fit_robust, fit_scaler, scale
from rillmeter.operators.selection import keep_columns, reduce_collinear, variance_filter
from rillmeter.schemas import FEATURES, FINAL_FEATURES, POWER_COLUMNS, ROBUST_COLUMNS, SCALED_ORDER


def numpy_yj(x, lam):
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if lam == 0 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if lam == 2 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def numpy_lambda(x):
    """Coarse-to-fine grid search of the likelihood."""
    def score(lam):
        return -len(x) / 2 * np.log(numpy_yj(x, lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    low, high = -20.0, 20.0
    for _ in range(12):
        grid = np.linspace(low, high, 81)
        best = grid[np.argmax([score(g) for g in grid])]
        step = grid[1] - grid[0]
        low, high = best - 2 * step, best + 2 * step
    return best


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(5)
    rows = []
    for h, n in (("north", 400), ("south", 250)):
        data = {f: rng.normal(size=n) for f in FEATURES}
        data["water_usage_cv"] = rng.gamma(2, 0.1, n)
        data["temp_sensitivity_corr"] = 1 - rng.gamma(1.5, 0.4, n)
        data["landscape_demand_index"] = rng.choice([0.2, 0.3, 0.6, 0.8, 1.0], n)
        rows += [(h, f"{h}{i}", *[float(data[f][i]) for f in FEATURES]) for i in range(n)]
    ddl = "hemisphere STRING, household_id STRING, " + ", ".join(f"{f} DOUBLE" for f in FEATURES)
    df = spark.createDataFrame(rows, ddl).persist()
    yield df, df.toPandas()
    df.unpersist()


def test_transform_branches(spark):
    x = np.array([-3.0, -0.5, 0.0, 0.4, 7.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x DOUBLE")
    for lam in (-1.5, 0.0, 0.7, 1.0, 2.0, 3.2):
        got = [r[0] for r in df.select(yeo_johnson(F.col("x"), F.lit(lam))).collect()]
        assert np.allclose(got, numpy_yj(x, lam), rtol=1e-13)


def test_lambda_equals_grid_search(features):
    df, pdf = features
    for (h, c), lam in fit_lambdas(df).items():
        assert lam == pytest.approx(numpy_lambda(pdf[pdf.hemisphere == h][c].to_numpy()), abs=1e-5)


def test_lambda_just_inside_the_first_bracket(spark):
    """Of normal values under the inverse transform the lambda is known. One between the first bracket's end and the candidate
    next to it is passed by the bracket that moves outwards, which must then not move back past it."""
    y = np.array([NormalDist().inv_cdf((i + 0.5) / 500) for i in range(500)]) * 0.01 + 0.15
    near = {f"h{i}": lam for i, lam in enumerate((-1.97, -1.86, -1.78, -9.9, 1.8, 1.95, 9.9))}
    values = {h: (1 + lam * (y if lam > 0 else y / 3)) ** (1 / lam) - 1 for h, lam in near.items()}
    rows = [(h, float(v)) for h, x in values.items() for v in x]
    found = fit_lambdas(spark.createDataFrame(rows, "hemisphere STRING, water_usage_cv DOUBLE"), ["water_usage_cv"])
    assert {h: lam for (h, _), lam in found.items()} == pytest.approx({h: numpy_lambda(x) for h, x in values.items()}, abs=1e-4)
    assert {h: lam for (h, _), lam in found.items()} == pytest.approx(near, abs=0.1)


def test_lambda_of_columns_that_lie_close_together_far_from_zero(spark):
    """The transformed values agree in all but a few digits there, and so did the likelihoods of their lambdas."""
    rng = np.random.default_rng(3)
    skew = lambda n: (rng.gamma(20, 1, n) - 20) / 20**0.5
    values = {"a": 0.67 + 0.0067 * skew(500), "b": 2 + 0.02 * skew(500), "c": -0.67 - 0.0067 * skew(500), "d": 0.116 + 0.00116 * skew(3000)}
    rows = [(h, float(v)) for h, x in values.items() for v in x]
    found = fit_lambdas(spark.createDataFrame(rows, "hemisphere STRING, water_usage_cv DOUBLE"), ["water_usage_cv"])
    for h, x in values.items():
        gain = np.log1p(np.abs(x))
        gain -= gain.mean()  # the likelihood does not change by the factor this takes away, but for a constant
        power = lambda lam: lam if h != "c" else 2 - lam
        score = lambda lam: -len(x) / 2 * np.log((np.expm1(gain * power(lam)) / power(lam)).var())
        lam = found[h, "water_usage_cv"]
        assert score(lam) > max(score(lam - 0.05), score(lam + 0.05)) and abs(power(lam)) > 10


def test_power_scaled_columns_are_standardised(features):
    df, _ = features
    scaled = scale(df, fit_power(df), POWER_COLUMNS).groupBy("hemisphere").agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in POWER_COLUMNS for f in (F.avg, F.stddev_pop)]
    )
    for row in scaled.collect():
        for c in POWER_COLUMNS:
            assert row[f"avg_{c}"] == pytest.approx(0, abs=1e-9) and row[f"stddev_pop_{c}"] == pytest.approx(1)


def test_robust_scaled_columns(features):
    df, pdf = features
    out = scale(df, fit_scaler(df)).toPandas()
    assert list(out.columns[2:]) == list(SCALED_ORDER)
    for h in ("north", "south"):
        for c in ROBUST_COLUMNS:
            x = pdf[pdf.hemisphere == h].set_index("household_id")[c]
            low, middle, high = np.percentile(x, [5, 50, 95])
            got = out[out.hemisphere == h].set_index("household_id")[c].reindex(x.index)
            assert np.allclose(got, (x - middle) / (high - low), rtol=1e-12, atol=1e-13)


def test_constant_column_divides_by_one_and_is_filtered(features):
    df, _ = features
    flat = df.withColumn("baseline_peak_ratio", F.lit(0.3))
    params = fit_robust(flat)
    row = params.where((F.col("column") == "baseline_peak_ratio") & (F.col("hemisphere") == "north")).first()
    assert row["scale"] == 1.0 and row["center"] == 0.3
    scaled = scale(flat, params, ROBUST_COLUMNS)
    kept = variance_filter(scaled, ROBUST_COLUMNS)
    assert all("baseline_peak_ratio" not in names and len(names) == 7 for names in kept.values())
    assert "baseline_peak_ratio" not in keep_columns(scaled, kept, ROBUST_COLUMNS).columns


def test_column_flat_in_one_hemisphere_only_is_blanked_there(features):
    df, _ = features
    half = df.withColumn("baseline_peak_ratio", F.when(F.col("hemisphere") == "north", 0.3).otherwise(F.col("baseline_peak_ratio")))
    kept = variance_filter(half, FEATURES)
    counts = keep_columns(half, kept, FEATURES).groupBy("hemisphere").agg(F.count("baseline_peak_ratio").alias("n"))
    assert {r["hemisphere"]: r["n"] for r in counts.collect()} == {"north": 0, "south": 250}


def test_constant_power_column_keeps_lambda_one(features):
    df, _ = features
    flat = df.withColumn("water_usage_cv", F.lit(0.4))
    assert fit_lambdas(flat)["north", "water_usage_cv"] == 1.0


def test_power_column_constant_but_for_rounding_keeps_lambda_one(spark):
    """Households of the same habits: their ratios agree, but the sums behind them were rounded differently."""
    rng = np.random.default_rng(4)
    values = {
        "a": [0.4, float(np.nextafter(0.4, 1))] * 20,
        "b": (0.4 * (1 + rng.integers(-3, 4, 500) * 2.0**-52)).tolist(),
        "c": (-0.3 * (1 + rng.integers(-9, 10, 200) * 2.0**-52)).tolist(),
    }
    rows = [(h, f"{h}{i}", v) for h, x in values.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "hemisphere STRING, household_id STRING, water_usage_cv DOUBLE")
    params = fit_power(df, ["water_usage_cv"])
    assert {r["hemisphere"]: r["lambda"] for r in params.collect()} == dict.fromkeys("abc", 1.0)
    assert scale(df, params, ["water_usage_cv"]).agg(F.max(F.abs("water_usage_cv"))).first()[0] < 1e-13


def test_final_four(features):
    df, _ = features
    final = reduce_collinear(scale(df, fit_robust(df), SCALED_ORDER))
    assert tuple(final.columns[2:]) == FINAL_FEATURES == (
        "log_per_capita_usage", "dry_day_spike_factor", "efficiency_penalty_ratio", "landscape_demand_index"
    )
