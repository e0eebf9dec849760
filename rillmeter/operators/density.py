"""Histograms, kernel densities and quantile-quantile data."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmeter.functions.distributions import gamma_quantile, gamma_shape, normal_quantile
from rillmeter.operators.ranking import local_table, melt, ordered_positions
from rillmeter.session import pin_small

# Histogram bins and density grid points of the univariate views.
BINS = 50
GRID_POINTS = 300
#: Bandwidths from a value at which its kernel ends; there it is 1.3e-14 of its peak.
KERNEL_REACH = 8.0


def histogram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("hemisphere",), bins: int = BINS) -> DataFrame:
    """Equal-width density histogram on [min, max]; the last bin is closed.

    A constant column spreads half a unit to either side, as NumPy does. Bins
    without rows are absent.
    """
    names = [*by, "column"]
    cells = melt(df, by, columns)
    flat = F.col("hi") == F.col("lo")
    edges = (
        cells.groupBy(*names)
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("total"))
        .select(
            *names, "total",
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
        .withColumn("width", (F.col("hi") - F.col("lo")) / F.lit(bins))
    )
    bin_index = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1))
    return (
        cells.join(pin_small(edges), names)
        .groupBy(*names, "lo", "width", "total", bin_index.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *names, "bin",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
            "n",
            (F.col("n") / (F.col("total") * F.col("width"))).alias("density"),
        )
    )


def kernel_density(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("hemisphere",),
    sample: DataFrame | None = None, points: int = GRID_POINTS,
) -> DataFrame:
    """Gaussian kernel density on an even grid over [min, max], Scott bandwidth.

    The grid spans ``df``; the kernels sit on ``sample`` if one is given. Equal values are counted first, and each
    distinct value meets the grid points within ``KERNEL_REACH`` bandwidths, found by arithmetic on the grid, inside its own
    task, summed before any shuffle. What is left out is at most exp(-KERNEL_REACH**2 / 2) of a kernel's peak at any point. A
    constant column has no bandwidth and yields no rows.
    """
    names = [*by, "column"]
    span = melt(df, by, columns).groupBy(*names).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    kernels = melt(sample if sample is not None else df, by, columns)
    scale = kernels.groupBy(*names).agg(F.count(F.lit(1)).alias("m"), F.stddev_samp("value").alias("s"))
    grid = pin_small(
        span.join(scale, names)
        .where(F.col("s") > 0)
        .withColumn("h", F.col("s") * F.pow(F.col("m").cast("double"), F.lit(-0.2)))
        .withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(points - 1))
    )
    weights = kernels.groupBy(*names, "value").agg(F.count(F.lit(1)).alias("w"))
    x = F.col("lo") + F.col("point") * F.col("step")
    place = lambda v: (v - F.col("lo")) / F.col("step")
    first = F.greatest(F.ceil(place(F.col("value") - KERNEL_REACH * F.col("h"))), F.lit(0)).cast("int")
    last = F.least(F.floor(place(F.col("value") + KERNEL_REACH * F.col("h"))), F.lit(points - 1)).cast("int")
    kernel = F.exp(F.lit(-0.5) * F.pow((x - F.col("value")) / F.col("h"), F.lit(2.0)))
    mass = (
        weights.join(grid, names)
        .withColumns({"first": first, "last": last})
        .where(F.col("first") <= F.col("last"))
        .withColumn("point", F.explode(F.sequence("first", "last")))
        .groupBy(*names, "point")
        .agg(F.sum(F.col("w") * kernel).alias("mass"))
    )
    every = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))  # points far from all values too
    return every.join(mass, [*names, "point"], "left").select(
        *names, "point", x.alias("x"),
        (F.coalesce("mass", F.lit(0.0)) / (F.col("m") * F.col("h") * F.sqrt(2 * F.pi()))).alias("density"),
    )


def plotting_position() -> Column:
    """Filliben's estimate of the median of the i-th of n uniform order statistics."""
    i, n = F.col("position").cast("double"), F.col("n").cast("double")
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    inner = (i - 0.3175) / (n + 0.365)
    return F.when(i == n, last).when(i == 1, F.lit(1.0) - last).otherwise(inner)


def normal_qq(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str], by: Sequence[str] = ("hemisphere",),
    partitions: int | None = None,
) -> DataFrame:
    """Every value next to its normal quantile."""
    placed = ordered_positions(df, by, ids, columns, partitions)
    return placed.select(*by, "column", "position", normal_quantile(plotting_position()).alias("theoretical"), "value")


#: Distances of the location below the least value that are searched, in standard deviations; places tried in the
#: first pass and in each further one; and further passes.
REACH, FIRST_PLACES, PLACES, ZOOMS = (1e-6, 1e3), 32, 12, 3


@dataclass
class _Fit:
    """Likelihood of one group's column along the location, which lies exp(u) standard deviations below the least value."""

    key: tuple
    n: int
    mean: float
    least: float
    spread: float
    mean_log: float
    places: np.ndarray = None
    slope: np.ndarray = None
    logs: np.ndarray = None
    found: bool = False

    def locations(self) -> np.ndarray:
        return self.least - self.spread * np.exp(self.places)

    def read(self, logs: list[float], inverses: list[float]) -> None:
        """Slope of the likelihood at each place, the scale and shape being the best for it."""
        self.logs = np.array(logs)
        rest = self.mean - self.locations()
        shape = np.array([gamma_shape(m, x) or np.nan for m, x in zip(rest, self.logs)])
        self.slope = shape / rest - (shape - 1) * np.array(inverses)

    def narrow(self, places: int) -> None:
        """Keep the farthest place where the likelihood stops rising towards the least value: an inner maximum."""
        turns = np.flatnonzero((self.slope[:-1] > 0) & (self.slope[1:] <= 0))
        self.found = len(turns) > 0
        if self.found:
            i = turns[0]
            self.places = np.linspace(self.places[i], self.places[i + 1], places)

    def solved(self) -> tuple[float, float | None]:
        """Location and shape: the slope's root and the mean logarithm there, interpolated through all places."""
        if not self.found:
            return 0.0, gamma_shape(self.mean, self.mean_log)
        slope, logs = (_interpolated(self.places, y) for y in (self.slope, self.logs))
        i = np.flatnonzero((self.slope[:-1] > 0) & (self.slope[1:] <= 0))
        low, high = (self.places[i[0]], self.places[i[0] + 1]) if len(i) else (self.places[0], self.places[-1])
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if slope(middle) > 0 else (low, middle)
        location = self.least - self.spread * math.exp(low)
        return location, gamma_shape(self.mean - location, logs(low))


def _interpolated(x: np.ndarray, y: np.ndarray):
    """The polynomial through all points, in barycentric form."""
    scaled = (x - x[0]) / (x[-1] - x[0])
    weight = np.array([1 / np.prod(a - np.delete(scaled, i)) for i, a in enumerate(scaled)])

    def at(u: float) -> float:
        away = (u - x[0]) / (x[-1] - x[0]) - scaled
        if not away.all():
            return float(y[np.argmin(np.abs(away))])
        part = weight / away
        return float((part * y).sum() / part.sum())

    return at


def gamma_fits(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("hemisphere",)) -> DataFrame:
    """Gamma shape and location of the positive values, by maximum likelihood: ``(by..., column, n, shape, location, inner)``.

    For a location the best scale and shape follow from the mean and the mean logarithm of what is above it, and the
    slope of the likelihood from the mean inverse. A pass sums both for a few locations of every group and column in one
    aggregate; each narrows the search, and the last is interpolated. Of several inner maxima the one farthest below the
    least value counts. Data without one (skewed to the left, or densest at the least value) keep the location at zero,
    and ``inner`` is false. Constant data has no shape.
    """
    names = [*by, "column"]
    positive = melt(df, by, columns).where(F.col("value") > 0)
    moments = positive.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"),
        F.stddev_pop("value").alias("spread"), F.avg(F.ln("value")).alias("mean_log"),
    )
    rows = moments.collect()  # one per group and column
    fits = [_Fit(tuple(r[k] for k in names), r["n"], r["mean"], r["least"], r["spread"], r["mean_log"]) for r in rows]
    active = [f for f in fits if f.spread > 0]
    group_ddl = [f"{b} {df.schema[b].dataType.simpleString()}" for b in by] + ["column STRING"]
    places = FIRST_PLACES
    for f in active:
        f.places = np.linspace(math.log(REACH[1]), math.log(REACH[0]), places)
    for zoom in range(ZOOMS + 1):
        if not active:
            break
        table = local_table(
            df.sparkSession,
            {k: [f.key[i] for f in active] for i, k in enumerate(names)} | {"at": [f.locations().tolist() for f in active]},
            ", ".join([*group_ddl, "at ARRAY<DOUBLE>"]),
        )
        on = F.lit(True)
        for k in names:
            on &= positive[k].eqNullSafe(table[k])
        above = [F.col("value") - F.get("at", F.lit(i)) for i in range(places)]
        sums = (
            positive.join(F.broadcast(table), on).groupBy(*[positive[k] for k in names])
            .agg(F.array(*[F.avg(F.ln(x)) for x in above]).alias("logs"), F.array(*[F.avg(1 / x) for x in above]).alias("inverses"))
            .collect()
        )
        read = {tuple(r[k] for k in names): r for r in sums}
        for f in active:
            f.read(read[f.key]["logs"], read[f.key]["inverses"])
        if zoom < ZOOMS:
            for f in active:
                f.narrow(PLACES)
            active = [f for f in active if f.found]
            places = PLACES
    solved = [f.solved() for f in fits]
    data = {k: [f.key[i] for f in fits] for i, k in enumerate(names)}
    data |= {"n": [f.n for f in fits], "shape": [s for _, s in solved], "location": [x for x, _ in solved], "inner": [f.found for f in fits]}
    return local_table(df.sparkSession, data, ", ".join([*group_ddl, "n BIGINT", "shape DOUBLE", "location DOUBLE", "inner BOOLEAN"]))


def gamma_qq(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str], by: Sequence[str] = ("hemisphere",),
    partitions: int | None = None,
) -> DataFrame:
    """Every positive value next to its quantile under the fitted gamma shape, in the standard form (location 0, scale 1).

    ``qq_line`` of the points reads the scale and the location off again.
    """
    positive = df.select(
        *by, *ids, *[F.when(F.col(c) > 0, F.col(c).cast("double")).alias(c) for c in columns]
    )
    placed = ordered_positions(positive, by, ids, columns, partitions)
    fitted = placed.join(F.broadcast(gamma_fits(df, columns, by).drop("n", "location", "inner")), [*by, "column"])
    return fitted.select(
        *by, "column", "position", gamma_quantile(plotting_position(), F.col("shape")).alias("theoretical"), "value"
    )


def qq_line(points: DataFrame, by: Sequence[str] = ("hemisphere",)) -> DataFrame:
    """Least-squares line and correlation of ordered values on theoretical quantiles."""
    spread_x, spread_y = F.stddev_pop("theoretical"), F.stddev_pop("value")
    covariance = F.covar_pop("theoretical", "value")
    slope = F.try_divide(covariance, spread_x * spread_x)
    return points.groupBy(*by, "column").agg(
        slope.alias("slope"),
        (F.avg("value") - slope * F.avg("theoretical")).alias("intercept"),
        F.try_divide(covariance, spread_x * spread_y).alias("r"),
    )
