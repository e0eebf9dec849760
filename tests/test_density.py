import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmeter.functions import distributions as dist
from rillmeter.operators import density


@pytest.fixture(scope="module")
def sample(spark):
    x = np.random.default_rng(3).gamma(3, 2, 1500).round(2)
    return x, spark.createDataFrame([("n", i, float(v)) for i, v in enumerate(x)], "hemisphere STRING, id INT, x DOUBLE")


def test_normal_quantile_equals_the_standard_library(spark):
    ps = [1e-300, 1e-12, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.77, 0.926, 0.9999999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p DOUBLE").select(dist.normal_quantile(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], rtol=1e-12, atol=1e-14)


def test_gamma_quantile():
    # Shape 1 is the exponential distribution; shape n sums n of them.
    p = np.array([1e-6, 0.1, 0.5, 0.9, 0.999999])
    assert np.allclose(dist.gamma_ppf(p, np.ones(5)), -np.log1p(-p), rtol=1e-9)
    for shape in (0.05, 0.8, 7.5, 400.0):
        shapes = np.full(5, shape)
        assert np.allclose(dist.gamma_cdf(shapes, dist.gamma_ppf(p, shapes)), p, rtol=1e-8)


def test_gamma_shape_is_recovered():
    x = np.random.default_rng(0).gamma(2.5, 3.0, 200_000)
    assert dist.gamma_shape(x.mean(), np.log(x).mean()) == pytest.approx(2.5, rel=0.01)
    assert dist.gamma_shape(3.0, np.log(3.0)) is None
    assert dist.digamma(1.0) == pytest.approx(-0.5772156649015329)


def test_histogram_equals_numpy(sample):
    x, df = sample
    rows = {r["bin"]: r for r in density.histogram(df, ["x"]).collect()}
    counts, edges = np.histogram(x, bins=50)
    heights, _ = np.histogram(x, bins=50, density=True)
    assert sum(r["n"] for r in rows.values()) == len(x)
    for i in range(50):
        if counts[i]:
            # Values on an edge may fall to either side of it in floating point.
            assert abs(rows[i]["n"] - counts[i]) <= 2 and rows[i]["left_edge"] == pytest.approx(edges[i])
            assert rows[i]["density"] == pytest.approx(heights[i] * rows[i]["n"] / counts[i])


def test_constant_histogram(spark):
    row = density.histogram(spark.createDataFrame([("n", 4.0)] * 3, "hemisphere STRING, x DOUBLE"), ["x"]).collect()
    assert len(row) == 1 and row[0]["bin"] == 25 and row[0]["density"] == pytest.approx(50.0)


def test_density_equals_the_formula(sample):
    x, df = sample
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 300)
    expected = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    rows = density.kernel_density(df, ["x"]).orderBy("point").collect()
    assert np.allclose([r["x"] for r in rows], grid) and np.allclose([r["density"] for r in rows], expected)


def filliben(n):
    p = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    p[-1] = 0.5 ** (1 / n)
    p[0] = 1 - p[-1]
    return p


def test_normal_qq(sample):
    x, df = sample
    points = density.normal_qq(df, ["x"], ["id"], partitions=30)
    rows = points.orderBy("position").collect()
    assert [r["value"] for r in rows] == sorted(x)
    theoretical = np.array([NormalDist().inv_cdf(p) for p in filliben(len(x))])
    assert np.allclose([r["theoretical"] for r in rows], theoretical)
    line = density.qq_line(points).first()
    slope, intercept = np.polyfit(theoretical, np.sort(x), 1)
    assert (line["slope"], line["intercept"]) == pytest.approx((slope, intercept))


def log_likelihood(x, location, shape):
    y = x - location
    scale = y.mean() / shape
    return -shape * np.log(scale) - math.lgamma(shape) + (shape - 1) * np.log(y).mean() - shape


def brute_fit(x):
    """Location and shape of the inner maximum: the likelihood on a fine grid, then halved by its slope."""

    def shape_at(location):
        y = x - location
        return dist.gamma_shape(y.mean(), np.log(y).mean())

    def slope(d):
        location, step = x.min() - d, 1e-5 * d
        a, b = location - step, location + step
        return log_likelihood(x, b, shape_at(b)) - log_likelihood(x, a, shape_at(a))

    far = np.geomspace(1000, 1e-4, 400) * x.std()
    values = [log_likelihood(x, x.min() - d, shape_at(x.min() - d)) for d in far]
    i = next(i for i in range(1, 399) if values[i] > values[i - 1] and values[i] >= values[i + 1])
    high, low = far[i - 1], far[i + 1]
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if slope(middle) > 0 else (middle, high)
    return x.min() - middle, shape_at(x.min() - middle)


def test_gamma_fits_equal_a_brute_force_search(spark):
    r = np.random.default_rng(8)
    columns = {"x": 7 + 3 * r.gamma(2.5, size=3000), "y": 5 + r.gamma(9, size=3000), "z": np.round(2 + r.gamma(1.7, 4, size=3000), 1) + 0.05}
    rows = [("g", *map(float, v)) for v in zip(*columns.values())] + [(None, float(v), -1.0, None) for v in columns["y"][:500]]
    fits = density.gamma_fits(spark.createDataFrame(rows, "hemisphere STRING, x DOUBLE, y DOUBLE, z DOUBLE"), list(columns))
    found = {(f["hemisphere"], f["column"]): f for f in fits.collect()}
    assert set(found) == {("g", "x"), ("g", "y"), ("g", "z"), (None, "x")}
    for key, values in ((("g", "x"), columns["x"]), (("g", "y"), columns["y"]), (("g", "z"), columns["z"]), ((None, "x"), columns["y"][:500])):
        location, shape = brute_fit(values)
        assert found[key]["inner"] and found[key]["n"] == len(values)
        # The likelihood is flat at its top: its differences tell the place to about 1e-5.
        assert (found[key]["location"], found[key]["shape"]) == pytest.approx((location, shape), rel=2e-5)
        y = values - found[key]["location"]
        k = found[key]["shape"]
        assert abs(k / y.mean() - (k - 1) * (1 / y).mean()) < 1e-9 * k  # the slope in the location
        assert abs(math.log(k) - dist.digamma(k) - math.log(y.mean()) + np.log(y).mean()) < 1e-9  # and in the shape


def test_gamma_fits_without_an_inner_maximum(spark):
    r = np.random.default_rng(9)
    left, dense = 30 - r.gamma(2, size=2000), r.gamma(0.4, size=2000)
    rows = [(float(a), float(b), 4.0) for a, b in zip(left, dense)]
    fits = density.gamma_fits(spark.createDataFrame(rows, "x DOUBLE, y DOUBLE, c DOUBLE"), ["x", "y", "c"], by=())
    found = {f["column"]: f for f in fits.collect()}
    assert not any(f["inner"] or f["location"] for f in found.values()) and found["c"]["shape"] is None
    assert found["x"]["shape"] == pytest.approx(dist.gamma_shape(left.mean(), np.log(left).mean()))
    assert density.gamma_fits(spark.createDataFrame([], "x DOUBLE"), ["x"], by=()).collect() == []


def poisson_tail(shape, x):
    """1 - P(shape, x) for a whole shape, by exact sums of logarithms."""
    terms = [i * math.log(x) - x - math.lgamma(i + 1) for i in range(shape)]
    top = max(terms)
    return math.exp(top) * math.fsum(math.exp(t - top) for t in terms)


@pytest.mark.parametrize("shape", [1, 3, 40, 900, 9_999, 10_001, 40_000])
def test_gamma_cdf_at_any_shape(shape):
    x = shape + np.array([-4.0, -1.0, 0.0, 0.5, 3.0]) * math.sqrt(shape)
    x = x[x > 0]
    assert np.allclose(1 - dist.gamma_cdf(np.full(len(x), float(shape)), x), [poisson_tail(shape, v) for v in x], rtol=1e-8, atol=1e-12)


def test_gamma_cdf_at_very_large_shapes():
    # The median lies a third below the mean, the deviations are normal to order 1 / sqrt(shape).
    for shape in (1e8, 1e10, 1e12):
        assert dist.gamma_cdf(np.array([shape]), np.array([shape - 1 / 3]))[0] == pytest.approx(0.5, abs=1e-9)
        assert dist.gamma_cdf(np.array([shape]), np.array([shape]))[0] == pytest.approx(0.5 + 1 / (3 * math.sqrt(2 * math.pi * shape)), abs=1e-9)
        p = np.array([0.001, 0.5, 0.999])
        assert np.allclose(dist.gamma_cdf(np.full(3, shape), dist.gamma_ppf(p, np.full(3, shape))), p, atol=1e-6)


def test_kernels_reach_eight_bandwidths(spark):
    """Far fewer points than the whole grid meet a value, points without any have zero, and the rest is the formula."""
    x = np.concatenate([np.random.default_rng(2).normal(size=400), [60.0, 61.0]])
    df = spark.createDataFrame([("n", float(v)) for v in x], "hemisphere STRING, x DOUBLE")
    rows = density.kernel_density(df, ["x"]).orderBy("point").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 300)
    expected = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert [r["point"] for r in rows] == list(range(300))
    assert np.allclose([r["density"] for r in rows], expected, rtol=1e-9, atol=1e-14)
    assert sum(r["density"] == 0 for r in rows) > 50


def test_gamma_qq_uses_positive_values(sample):
    x, df = sample
    with_zeros = df.unionByName(df.limit(40).select("hemisphere", (F.col("id") + 10_000).alias("id"), F.lit(0.0).alias("x")))
    rows = density.gamma_qq(with_zeros, ["x"], ["id"]).orderBy("position").collect()
    _, shape = brute_fit(x)
    assert [r["value"] for r in rows] == sorted(x)
    assert np.allclose([r["theoretical"] for r in rows], dist.gamma_ppf(filliben(len(x)), np.full(len(x), shape)))
