"""Fit and apply the two scalers. Parameters live in a small table, one row per hemisphere and column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmeter.functions.power import log_jacobian, yeo_johnson, yeo_johnson_from, yeo_johnson_slope
from rillmeter.operators.ranking import DIRECT_ROWS, exact_quantiles, local_table, melt
from rillmeter.schemas import KEYS, POWER_COLUMNS, ROBUST_COLUMNS, SCALED_ORDER

# Quantile range of the robust scaler.
ROBUST_RANGE = (0.05, 0.95)
#: A spread below this counts as zero and divides by one.
ZERO_SPREAD = 10 * 2.220446049250313e-16

PARAMS_DDL = "hemisphere STRING, column STRING, lambda DOUBLE, center DOUBLE, scale DOUBLE"

CANDIDATES = 17
START = (-2.0, 2.0)
#: Stop comparing likelihoods once candidates are this close; so many passes then look for the derivative's zero.
#: Where ``log(1 + |x|)`` spans less than ``WIDE``, lambda moves the values less and the step is as much wider.
FINE_STEP = 1e-3
WIDE = 0.1
ZOOMS = 3
LARGEST_LAMBDA = 512.0
#: Columns whose values all lie this close, relative to the largest, differ by the rounding of a year's sums only.
SAME = 1e-13


def _spread(x: float) -> float:
    return 1.0 if x < ZERO_SPREAD else x


def fit_robust(
    features: DataFrame, columns: Sequence[str] = ROBUST_COLUMNS, direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Median and 5-95 range of each column, exact, per hemisphere."""
    probs = [ROBUST_RANGE[0], 0.5, ROBUST_RANGE[1]]
    fitted = exact_quantiles(features, ["hemisphere"], columns, probs, direct_rows)
    known = {k: q for k, q in fitted.items() if q[1] is not None}
    data = {
        "hemisphere": [group[0] for group, _ in known],
        "column": [column for _, column in known],
        "lambda": [None] * len(known),
        "center": [q[1] for q in known.values()],
        "scale": [_spread(q[2] - q[0]) for q in known.values()],
    }
    return local_table(features.sparkSession, data, PARAMS_DDL)


Bracket = tuple[float, float]
Key = tuple[str, str]


def _origin(lo: float, hi: float) -> float:
    """Middle of a column's ``log(1 + |x|)``; zero where it has both signs."""
    return 0.0 if lo < 0 <= hi or lo <= 0 < hi else (math.log1p(abs(lo)) + math.log1p(abs(hi))) / 2


def _constant(lo: float, hi: float) -> bool:
    """Whether a column has one value, but for rounding."""
    return hi - lo <= SAME * max(abs(lo), abs(hi))


def _fine_step(lo: float, hi: float) -> float:
    """Least step at which likelihoods of a column between ``lo`` and ``hi`` differ by more than their rounding."""
    span = abs(math.copysign(math.log1p(abs(hi)), hi) - math.copysign(math.log1p(abs(lo)), lo))
    return FINE_STEP * max(1.0, WIDE / span) if span else math.inf


def _candidate_sums(cells: DataFrame, brackets: dict[Key, Bracket], origins: dict[Key, float], *more: Column) -> list:
    """Count, Jacobian, variance of the transformed values and ``more``, for every candidate of every bracket.

    Values are transformed from the column's origin on. The likelihood differs by a constant for that: the
    transform's factor leaves the logarithm of the variance for the Jacobian. Each cell meets its candidates inside its task and is summed there, so the
    shuffle carries one row per candidate.
    """
    keys = list(brackets)
    table = local_table(
        cells.sparkSession,
        {
            "hemisphere": [k[0] for k in keys],
            "column": [k[1] for k in keys],
            "low": [brackets[k][0] for k in keys],
            "step": [(brackets[k][1] - brackets[k][0]) / (CANDIDATES - 1) for k in keys],
            "origin": [origins[k] for k in keys],
        },
        "hemisphere STRING, column STRING, low DOUBLE, step DOUBLE, origin DOUBLE",
    )
    value, origin = F.col("value"), F.col("origin")
    lam = F.col("low") + F.col("candidate") * F.col("step")
    return (
        cells.join(F.broadcast(table), ["hemisphere", "column"])
        .withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(CANDIDATES - 1))))
        .withColumns({"y": yeo_johnson_from(value, lam, origin), "slope": yeo_johnson_slope(value, lam, origin)})
        .groupBy("hemisphere", "column", "candidate")
        .agg(
            F.count("value").alias("n"),
            F.sum(log_jacobian(value, origin)).alias("jacobian"),
            F.var_pop("y").alias("variance"),
            *more,
        )
        .collect()
    )


def _likelihoods(cells: DataFrame, brackets: dict[Key, Bracket], origins: dict[Key, float]) -> dict:
    """Log-likelihood of every candidate of every bracket, in one pass over the cells."""
    out = {key: [-math.inf] * CANDIDATES for key in brackets}
    for r in _candidate_sums(cells, brackets, origins):
        key, j, v = (r["hemisphere"], r["column"]), r["candidate"], r["variance"]
        if v is None or not math.isfinite(v) or v <= 0:
            continue
        low, high = brackets[key]
        lam = low + j * (high - low) / (CANDIDATES - 1)
        out[key][j] = -r["n"] / 2 * math.log(v) + (lam - 1) * r["jacobian"]
    return out


def _zero_slopes(cells: DataFrame, brackets: dict[Key, Bracket], origins: dict[Key, float]) -> dict[Key, float]:
    """Where the derivative of the likelihood is zero in each bracket.

    ``ZOOMS`` passes of candidates narrow a bracket to where the sign changes; a line through both ends finishes.
    Near the maximum the likelihood is flat, so comparing its values would know lambda to half the digits only.
    """
    found: dict[Key, float] = {}
    for zoom in range(ZOOMS if brackets else 0):
        slopes = {key: [math.nan] * CANDIDATES for key in brackets}
        for r in _candidate_sums(cells, brackets, origins, F.covar_pop("y", "slope").alias("covariance")):
            slopes[r["hemisphere"], r["column"]][r["candidate"]] = r["jacobian"] - r["n"] * r["covariance"] / r["variance"]
        for key, (low, high) in brackets.items():
            s, step = slopes[key], (high - low) / (CANDIDATES - 1)
            j = min(max((i for i in range(CANDIDATES) if s[i] > 0), default=0), CANDIDATES - 2)
            if not s[j] > 0 >= s[j + 1]:
                raise ValueError(f"the likelihood of {key} has no maximum between {low} and {high}")
            brackets[key] = (low + j * step, low + (j + 1) * step)
            found[key] = low + (j + s[j] / (s[j] - s[j + 1])) * step
    return found


def fit_lambdas(features: DataFrame, columns: Sequence[str] = POWER_COLUMNS) -> dict[tuple[str, str], float]:
    """Maximum-likelihood lambda per hemisphere and column.

    Every pass scores 17 candidates for all brackets at once; a bracket whose
    best candidate lies at its end moves outwards and doubles, else it shrinks
    eightfold. An end from which the likelihood was seen to rise inwards is not
    passed again: where a bracket came from the right, a best candidate at its right
    end means a maximum next to it. The maximum itself is where the likelihood's
    derivative is zero.
    """
    cells = melt(features, ["hemisphere"], columns)
    spans = cells.groupBy("hemisphere", "column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    varied = {(r["hemisphere"], r["column"]): (r["lo"], r["hi"]) for r in spans if not _constant(r["lo"], r["hi"])}
    # A constant column stays as it is, which is lambda one.
    found: dict = {(r["hemisphere"], r["column"]): 1.0 for r in spans if _constant(r["lo"], r["hi"])}
    brackets = dict.fromkeys(varied, START)
    origins = {key: _origin(*ends) for key, ends in varied.items()}
    fine = {key: _fine_step(*ends) for key, ends in varied.items()}
    closed = dict.fromkeys(brackets, (False, False))  # whether the maximum is known to be inside the lower and upper end
    peaks: dict[tuple[str, str], tuple[float, float]] = {}
    while brackets:
        scored = _likelihoods(cells, brackets, origins)
        following = {}
        for key, (low, high) in brackets.items():
            scores, step = scored[key], (high - low) / (CANDIDATES - 1)
            best = max(range(CANDIDATES), key=scores.__getitem__)
            if not math.isfinite(scores[best]):
                raise ValueError(f"the likelihood of {key} is not finite between {low:g} and {high:g}")
            outwards = (best == 0 and not closed[key][0]) or (best == CANDIDATES - 1 and not closed[key][1])
            if outwards and max(abs(low), abs(high)) < LARGEST_LAMBDA:
                reach = 2 * (high - low)
                following[key] = (low - reach, low + step) if best == 0 else (high - step, high + reach)
                closed[key] = (best != 0, best == 0)
            elif outwards:
                raise ValueError(f"the likelihood of {key} still rises at lambda {low + best * step:g}")
            elif step > fine[key]:
                following[key] = (low + (best - 1) * step, low + (best + 1) * step)
                closed[key] = (True, True)
            else:
                peaks[key] = (low + (best - 1) * step, low + (best + 1) * step)
        brackets = following
    return found | _zero_slopes(cells, peaks, origins)


def fit_power(features: DataFrame, columns: Sequence[str] = POWER_COLUMNS) -> DataFrame:
    """Yeo-Johnson lambda per hemisphere and column, with mean and spread of the transformed values."""
    return standardise(features, fit_lambdas(features, columns))


def standardise(features: DataFrame, lambdas: dict[tuple[str, str], float]) -> DataFrame:
    """Mean and population spread after the transform, for given lambdas."""
    spark = features.sparkSession
    columns = sorted({c for _, c in lambdas})
    if not columns:
        return local_table(spark, {}, PARAMS_DDL)
    table = local_table(
        spark,
        {
            "hemisphere": [k[0] for k in lambdas],
            "column": [k[1] for k in lambdas],
            "lambda": list(lambdas.values()),
        },
        "hemisphere STRING, column STRING, lambda DOUBLE",
    )
    transformed = yeo_johnson(F.col("value"), F.col("lambda"))
    rows = (
        melt(features, ["hemisphere"], columns)
        .join(F.broadcast(table), ["hemisphere", "column"])
        .groupBy("hemisphere", "column", "lambda")
        .agg(F.avg(transformed).alias("center"), F.stddev_pop(transformed).alias("scale"))
        .collect()
    )
    data = {c: [r[c] for r in rows] for c in ("hemisphere", "column", "lambda", "center")}
    data["scale"] = [_spread(r["scale"]) for r in rows]
    return local_table(spark, data, PARAMS_DDL)


def fit_scaler(features: DataFrame, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Parameters of both scalers for all ten features. Hand in a stored table: several passes read it."""
    return fit_robust(features, ROBUST_COLUMNS, direct_rows).unionByName(fit_power(features, POWER_COLUMNS))


def scale(features: DataFrame, params: DataFrame, columns: Sequence[str] = SCALED_ORDER) -> DataFrame:
    """Apply fitted parameters: a projection over a broadcast row per hemisphere.

    Columns come out in the order robust block, power block. A column scaled
    without parameters for a hemisphere is NULL there.
    """
    position = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    wide = (
        params.where(F.col("column").isin(list(columns)))
        .groupBy("hemisphere")
        .agg(F.map_from_entries(F.collect_list(F.struct(position[F.col("column")], F.struct("lambda", "center", "scale")))).alias("by_position"))
        .select("hemisphere", F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.col("by_position")[i]).alias("fitted"))
    )
    scaled = []
    for i, c in enumerate(columns):
        fit = F.col("fitted")[i]
        value = F.col(c).cast("double")
        value = yeo_johnson(value, fit["lambda"]) if c in POWER_COLUMNS else value
        scaled.append(((value - fit["center"]) / fit["scale"]).alias(c))
    # The wide table has one row per hemisphere of the parameter table.
    return features.join(F.broadcast(wide), "hemisphere", "left").select(*KEYS, *scaled)
