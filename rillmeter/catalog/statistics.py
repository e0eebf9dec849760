"""C: profiling and statistics."""

from pyspark.sql import functions as F

from rillmeter.catalog import tables as t
from rillmeter.catalog.aggregates import (
    FEATURE_CELLS, KURTOSIS, LANDSCAPE_CELLS, MODES, MOMENTS, PERCENTILES, SKEWNESS, TRAIT_LONG, USAGE_LONG, box_sql, trait_profile,
)
from rillmeter.catalog.registry import query
from rillmeter.catalog.sql import long_of, r, with_tables
from rillmeter.functions import distributions as dist
from rillmeter.functions.expressions import one_hot
from rillmeter.functions.landscape import LANDSCAPE_TYPES
from rillmeter.operators import correlation, density, profile as pr
from rillmeter.operators.scoring import score_profiles
from rillmeter.schemas import FEATURES, FINAL_FEATURES, KEYS
from rillmeter.session import materialise

_HID = "hemisphere, household_id"
_NUMERIC = ("occupancy_count", "appliance_efficiency_score", "mean_daily_water_usage", "weekend_mean", "weekday_mean")
_DUMMIES = tuple(f"landscape_type_{x}" for x in sorted(LANDSCAPE_TYPES)[1:])
_TRAITS = (
    "traits AS (SELECT h.hemisphere, h.household_id, occupancy_count, appliance_efficiency_score, landscape_type, "
    "mean_usage AS mean_daily_water_usage, weekend_mean, weekday_mean, "
    + ", ".join(f"CASE WHEN landscape_type = '{x}' THEN 1 ELSE 0 END AS landscape_type_{x}" for x in sorted(LANDSCAPE_TYPES)[1:])
    + " FROM household h JOIN stats s ON h.hemisphere = s.hemisphere AND h.household_id = s.household_id)"
)


def _matrix_sql(table, columns):
    def item(a, b):
        flat = f"stddev_pop({a}) * stddev_pop({b}) = 0"
        return f"CASE WHEN {flat} THEN NULL ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"

    return " UNION ALL ".join(
        f"SELECT hemisphere, '{a}' AS a, '{b}' AS b, {r(r=item(a, b))} FROM {table} GROUP BY 1" for a in columns for b in columns
    )


def _ranked(table, columns):
    items = ", ".join(
        f"(rank() OVER (PARTITION BY hemisphere ORDER BY {c}) + count(*) OVER (PARTITION BY hemisphere ORDER BY {c})) / 2.0 AS {c}"
        for c in columns
    )
    return f"ranked AS (SELECT hemisphere, {items} FROM {table})"


def _traits(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    return one_hot(pr.traits_with_means(p.household, p.usage), "landscape_type", LANDSCAPE_TYPES)


@query("C1_pearson_traits", with_tables("stats", _matrix_sql("traits", _NUMERIC + _DUMMIES), _TRAITS))
def pearson_traits(spark, sf_dir):
    return correlation.pearson(_traits(spark, sf_dir), _NUMERIC + _DUMMIES)


@query("C1_pearson_features", with_tables("features", _matrix_sql("feat", FEATURES)))
def pearson_features(spark, sf_dir):
    return correlation.pearson(t.features(spark, sf_dir), FEATURES)


@query("C2_spearman_traits", with_tables("stats", _matrix_sql("ranked", _NUMERIC + _DUMMIES), _TRAITS, _ranked("traits", _NUMERIC + _DUMMIES)))
def spearman_traits(spark, sf_dir):
    traits = materialise(_traits(spark, sf_dir), "traits")
    return correlation.spearman(traits, _NUMERIC + _DUMMIES, ["household_id"])


@query("C2_spearman_features", with_tables("features", _matrix_sql("ranked", FEATURES), _ranked("feat", FEATURES)))
def spearman_features(spark, sf_dir):
    return correlation.spearman(t.stored_features(spark, sf_dir), FEATURES, ["household_id"])


def _profile_sql(level, cells, types, *extra):
    """Numeric profile rows of ``cells``; ``types`` is SQL giving the declared type."""
    keys = 'hemisphere, "column"'
    return with_tables(
        level,
        f"SELECT {keys}, {types} AS dtype, count(*) - count(value) AS null_count, "
        "count(DISTINCT value) + CASE WHEN count(*) > count(value) THEN 1 ELSE 0 END AS n_unique, "
        + r(min="min(value)", max="max(value)", mean="avg(value)", median="median(value)", mode="any_value(mode)",
            variance="var_samp(value)", std="stddev_samp(value)")
        + f" FROM cells LEFT JOIN modes USING ({keys}) GROUP BY ALL",
        cells, MODES, *extra,
    )


@query(
    "C3_profile_household",
    _profile_sql("panel", TRAIT_LONG, "CASE \"column\" WHEN 'occupancy_count' THEN 'int' ELSE 'double' END")
    + " UNION ALL SELECT hemisphere, 'landscape_type', 'string', count(*) - count(landscape_type), count(DISTINCT landscape_type), "
    "NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM household GROUP BY hemisphere",
)
def profile_household(spark, sf_dir):
    return trait_profile(spark, sf_dir)


_WEATHER = ("daily_max_temp_celsius", "daily_rainfall_mm")
_WEATHER_LONG = f"cells AS ({long_of('environment', _WEATHER, 'hemisphere, day_index')})"


@query("C3_profile_environment", _profile_sql("panel", _WEATHER_LONG, "'double'"))
def profile_environment(spark, sf_dir):
    environment = materialise(t.panel(spark, sf_dir).environment, "environment")
    return pr.profile(environment, _WEATHER)


_DAY_COLUMNS = (
    "cells AS (SELECT h.hemisphere, h.household_id, concat('column_', d.day_index) AS \"column\", CAST(liters AS DOUBLE) AS value "
    "FROM household h CROSS JOIN (SELECT range AS day_index FROM range(365)) d LEFT JOIN usage u "
    "ON h.hemisphere = u.hemisphere AND h.household_id = u.household_id AND d.day_index = u.day_index)"
)


@query("C3_profile_usage", _profile_sql("panel", _DAY_COLUMNS, "'float'"))
def profile_usage(spark, sf_dir):
    """All 365 day columns of the wide usage table."""
    from rillmeter.catalog.sources import usage_matrix
    from rillmeter.sources.layout import day_columns

    matrix = usage_matrix(spark, sf_dir)
    return pr.profile(matrix, day_columns(matrix.columns))


@query("C3_profile_features", _profile_sql("features", FEATURE_CELLS, "'double'"))
def profile_features(spark, sf_dir):
    return pr.profile(t.stored_features(spark, sf_dir), FEATURES)


def _summary_sql(level, cells):
    keys = 'hemisphere, "column"'
    return with_tables(
        level,
        f"SELECT {keys}, count(value) AS n, count(*) - count(value) AS null_count, count(DISTINCT value) AS unique_values, "
        + r(mean="avg(value)", mode="any_value(mode)", median="median(value)", std="stddev_pop(value)",
            skewness=SKEWNESS, kurtosis=KURTOSIS, min="min(value)", max="max(value)", **PERCENTILES)
        + f" FROM centred LEFT JOIN modes USING ({keys}) GROUP BY {keys}",
        cells, MODES, MOMENTS,
    )


_HOUSEHOLD_COLUMNS = ("occupancy_count", "appliance_efficiency_score")


@query("C4_univariate_household", _summary_sql("panel", TRAIT_LONG))
def univariate_household(spark, sf_dir):
    return pr.univariate_summary(t.panel(spark, sf_dir).household, _HOUSEHOLD_COLUMNS)


@query("C4_univariate_environment", _summary_sql("panel", _WEATHER_LONG))
def univariate_environment(spark, sf_dir):
    return pr.univariate_summary(materialise(t.panel(spark, sf_dir).environment, "environment"), _WEATHER)


@query("C4_univariate_features", _summary_sql("features", FEATURE_CELLS))
def univariate_features(spark, sf_dir):
    return pr.univariate_summary(t.stored_features(spark, sf_dir), FEATURES)


@query("C5_usage_summary", _summary_sql("panel", USAGE_LONG))
def usage_summary(spark, sf_dir):
    return pr.univariate_summary(t.stored_usage(spark, sf_dir), ["liters"])


def _histogram_sql(level, cells):
    keys = 'hemisphere, "column"'
    return with_tables(
        level,
        f"SELECT {keys}, bin, {r(left_edge='lo + bin * width')}, n, {r(density='n / (total * width)')} FROM "
        f"(SELECT {keys}, lo, width, total, CAST(least(floor((value - lo) / width), 49) AS INT) AS bin, count(*) AS n "
        f"FROM cells JOIN edges USING ({keys}) WHERE value IS NOT NULL GROUP BY ALL)",
        cells,
        f"edges AS (SELECT {keys}, min(value) AS lo, (max(value) - min(value)) / 50 AS width, count(value) AS total FROM cells GROUP BY {keys})",
    )


@query("C6_usage_histogram", _histogram_sql("panel", USAGE_LONG))
def usage_histogram(spark, sf_dir):
    return density.histogram(t.panel(spark, sf_dir).usage, ["liters"])


@query("C6_feature_histograms", _histogram_sql("features", FEATURE_CELLS))
def feature_histograms(spark, sf_dir):
    return density.histogram(t.stored_features(spark, sf_dir), FEATURES)


_DENSITY = (
    "spans AS (SELECT hemisphere, \"column\", min(value) AS lo, (max(value) - min(value)) / 299 AS step FROM cells GROUP BY 1, 2)",
    "widths AS (SELECT hemisphere, \"column\", count(*) AS m, stddev_samp(value) * pow(count(*), -0.2) AS h FROM kernels GROUP BY 1, 2)",
    "weights AS (SELECT hemisphere, \"column\", value, count(*) AS w FROM kernels GROUP BY 1, 2, 3)",
)
_DENSITY_SELECT = (
    "SELECT hemisphere, \"column\", CAST(point AS INT) AS point, " + r(x="lo + point * step", density="sum(w * exp(-0.5 * pow((lo + point * step - value) / h, 2))) / (m * h * sqrt(2 * pi()))")
    + " FROM weights JOIN widths USING (hemisphere, \"column\") JOIN spans USING (hemisphere, \"column\") "
    "CROSS JOIN (SELECT range AS point FROM range(300)) GROUP BY hemisphere, \"column\", point, lo, step, m, h"
)
_ALL_CELLS = "kernels AS (SELECT * FROM cells WHERE value IS NOT NULL)"
USAGE_CELLS = "cells AS (SELECT hemisphere, household_id, day_index, 'liters' AS \"column\", liters AS value FROM usage)"


@query("C7_usage_density", with_tables("panel", _DENSITY_SELECT, USAGE_CELLS, _ALL_CELLS, *_DENSITY))
def usage_density(spark, sf_dir):
    return density.kernel_density(t.stored_usage(spark, sf_dir), ["liters"])


@query("C7_trait_density", with_tables("panel", _DENSITY_SELECT, TRAIT_LONG, "kernels AS (SELECT * FROM cells)", *_DENSITY))
def trait_density(spark, sf_dir):
    return density.kernel_density(t.panel(spark, sf_dir).household, _HOUSEHOLD_COLUMNS)


def _polynomial(coefficients, x):
    out = f"{coefficients[-1]!r}::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _normal_quantile(p):
    q = f"({p} - 0.5)"
    inner = f"(0.180625::DOUBLE - {q} * {q})"
    d = f"sqrt(-ln(CASE WHEN {q} <= 0 THEN {p} ELSE 1 - {p} END))"
    central = f"{q} * {_polynomial(dist.CENTRAL_NUMERATOR, inner)} / {_polynomial(dist.CENTRAL_DENOMINATOR, inner)}"
    middle = f"{_polynomial(dist.MIDDLE_NUMERATOR, f'({d} - 1.6)')} / {_polynomial(dist.MIDDLE_DENOMINATOR, f'({d} - 1.6)')}"
    tail = f"{_polynomial(dist.TAIL_NUMERATOR, f'({d} - 5.0)')} / {_polynomial(dist.TAIL_DENOMINATOR, f'({d} - 5.0)')}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {central} ELSE sign({q}) * CASE WHEN {d} <= 5 THEN {middle} ELSE {tail} END END"


_POSITIONS = (
    "placed AS (SELECT hemisphere, \"column\", value, position, n, CASE WHEN position = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) "
    "WHEN position = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) ELSE (position - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM "
    "(SELECT *, row_number() OVER (PARTITION BY hemisphere, \"column\" ORDER BY value) AS position, "
    "count(*) OVER (PARTITION BY hemisphere, \"column\") AS n FROM kernels))"
)
_QQ_SELECT = f"SELECT hemisphere, \"column\", position, {r(theoretical=_normal_quantile('p'), value='value')} FROM placed"


@query("C8_usage_normal_qq", with_tables("panel", _QQ_SELECT, USAGE_CELLS, _ALL_CELLS, _POSITIONS))
def usage_normal_qq(spark, sf_dir):
    return density.normal_qq(t.stored_usage(spark, sf_dir), ["liters"], ["household_id", "day_index"])


@query("C8_feature_normal_qq", with_tables("features", _QQ_SELECT, FEATURE_CELLS, "kernels AS (SELECT * FROM cells WHERE value IS NOT NULL)", _POSITIONS))
def feature_normal_qq(spark, sf_dir):
    return density.normal_qq(t.stored_features(spark, sf_dir), FEATURES, ["household_id"])


def _line_sql(level, *cells):
    return with_tables(
        level,
        "SELECT hemisphere, \"column\", "
        + r(slope="CASE WHEN var_pop(x) = 0 THEN NULL ELSE covar_pop(x, value) / var_pop(x) END",
            intercept="CASE WHEN var_pop(x) = 0 THEN NULL ELSE avg(value) - covar_pop(x, value) / var_pop(x) * avg(x) END",
            r="CASE WHEN var_pop(x) * var_pop(value) = 0 THEN NULL ELSE covar_pop(x, value) / (stddev_pop(x) * stddev_pop(value)) END")
        + f" FROM (SELECT *, {_normal_quantile('p')} AS x FROM placed) GROUP BY 1, 2",
        *cells, _POSITIONS,
    )


@query("C8_qq_line", _line_sql("features", FEATURE_CELLS, "kernels AS (SELECT * FROM cells WHERE value IS NOT NULL)"))
def qq_line(spark, sf_dir):
    return density.qq_line(density.normal_qq(t.stored_features(spark, sf_dir), FEATURES, ["household_id"]))


@query("C8_usage_qq_line", _line_sql("panel", USAGE_CELLS, _ALL_CELLS))
def usage_qq_line(spark, sf_dir):
    return density.qq_line(density.normal_qq(t.stored_usage(spark, sf_dir), ["liters"], ["household_id", "day_index"]))


def _digamma(k: str) -> str:
    y = f"({k} + 8)"
    q = f"(1 / ({y} * {y}))"
    return f"(ln({y}) - 0.5 / {y} - {q} * (1.0 / 12 - {q} * (1.0 / 120 - {q} * (1.0 / 252 - {q} / 240)))" + "".join(f" - 1 / ({k} + {i})" for i in range(8)) + ")"


def _trigamma(k: str) -> str:
    y = f"({k} + 8)"
    q = f"(1 / ({y} * {y}))"
    return f"(1 / {y} + {q} / 2 + {q} / {y} * (1.0 / 6 - {q} * (1.0 / 30 - {q} * (1.0 / 42 - {q} / 30)))" + "".join(f" + 1 / (({k} + {i}) * ({k} + {i}))" for i in range(8)) + ")"


def _shaped(rows: str) -> str:
    """Shape k4 (Minka's iteration, from his estimate) and slope of the likelihood for rows of my, ml, inv: the mean,
    mean logarithm and mean inverse of what is above a location."""
    out = f"SELECT *, (3 - d + sqrt((d - 3) * (d - 3) + 24 * d)) / (12 * d) AS k0 FROM (SELECT *, ln(my) - ml AS d FROM ({rows}))"
    for i in range(4):
        k = f"k{i}"
        step = f"1 / (1 / {k} + (ln({k}) - {_digamma(k)} - d) / ({k} * {k} * (1 / {k} - {_trigamma(k)})))"
        out = f"SELECT *, {step} AS k{i + 1} FROM ({out})"
    return f"SELECT *, k4 / my - (k4 - 1) * inv AS slope FROM ({out})"


_LOCATION = "(least - s * exp(u))"
_ABOVE = (
    f"any_value(mean - {_LOCATION}) AS my, avg(ln(value - {_LOCATION})) AS ml, avg(1 / (value - {_LOCATION})) AS inv, any_value({_LOCATION}) AS location"
)
_REACH = "(ln(1e3::DOUBLE) - i * (ln(1e3::DOUBLE) - ln(1e-6::DOUBLE)) / 31)"
#: The likelihood's slope at 32 locations, the first turn from the far side, fifty halvings of it.
_GAMMA_SQL = with_tables(
    "panel",
    f"SELECT hemisphere, \"column\", n, {r(shape='coalesce(k4, flat)', location='coalesce(location, 0)')}, k4 IS NOT NULL AS inner FROM "
    f"(SELECT g, k4 AS flat FROM ({_shaped('SELECT g, avg(value) AS my, avg(ln(value)) AS ml, 0.0 AS inv FROM x GROUP BY g')})) "
    f"JOIN m USING (g) LEFT JOIN ({_shaped(f'SELECT g, {_ABOVE} FROM x JOIN m USING (g) JOIN (SELECT g, (hi + lo) / 2 AS u FROM b WHERE i = 50) USING (g) GROUP BY g')}) USING (g)",
    'cells AS (SELECT hemisphere, \'liters\' AS "column", CAST(liters AS DOUBLE) AS value FROM usage UNION ALL '
    "SELECT hemisphere, 'occupancy_count', CAST(occupancy_count AS DOUBLE) FROM household UNION ALL "
    "SELECT hemisphere, 'appliance_efficiency_score', appliance_efficiency_score FROM household)",
    'x AS MATERIALIZED (SELECT hemisphere || "column" AS g, * FROM cells WHERE value > 0)',
    'm AS MATERIALIZED (SELECT g, hemisphere, "column", count(*) AS n, avg(value) AS mean, min(value) AS least, stddev_pop(value) AS s FROM x GROUP BY ALL)',
    "scan AS MATERIALIZED (" + _shaped(f"SELECT g, u, {_ABOVE} FROM x JOIN m USING (g), (SELECT {_REACH} AS u FROM range(32) t(i)) GROUP BY g, u") + ")",
    "turn AS (SELECT g, max(u) AS hi, arg_max(near, u) AS lo FROM (SELECT *, lead(u) OVER w AS near, lead(slope) OVER w AS after FROM scan "
    "WINDOW w AS (PARTITION BY g ORDER BY u DESC)) WHERE slope > 0 AND after <= 0 GROUP BY g)",
    "b(i, g, hi, lo) AS (SELECT 0, g, hi, lo FROM turn UNION ALL SELECT i, g, CASE WHEN slope > 0 THEN u ELSE hi END, CASE WHEN slope > 0 THEN lo ELSE u END FROM ("
    + _shaped(
        f"SELECT g, any_value(i) + 1 AS i, any_value(hi) AS hi, any_value(lo) AS lo, any_value(u) AS u, {_ABOVE} "
        "FROM (SELECT b.*, (hi + lo) / 2 AS u, value, mean, least, m.s FROM b JOIN x USING (g) JOIN m USING (g) WHERE i < 50) GROUP BY g"
    )
    + "))",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("C9_gamma_fits", _GAMMA_SQL)
def gamma_fits(spark, sf_dir):
    traits = density.gamma_fits(t.panel(spark, sf_dir).household, _HOUSEHOLD_COLUMNS)
    return density.gamma_fits(t.stored_usage(spark, sf_dir), ["liters"]).union(traits)


@query("C9_usage_gamma_qq")
def usage_gamma_qq(spark, sf_dir):
    return density.gamma_qq(t.stored_usage(spark, sf_dir), ["liters"], ["household_id", "day_index"])


@query("C9_trait_gamma_qq")
def trait_gamma_qq(spark, sf_dir):
    return density.gamma_qq(t.panel(spark, sf_dir).household, _HOUSEHOLD_COLUMNS, ["household_id"])


@query(
    "C10_temporal_panel",
    with_tables(
        "panel",
        f"SELECT hemisphere, day_index, {r('daily_max_temp_celsius', 'daily_rainfall_mm', mean_liters='avg(liters)')} "
        "FROM environment JOIN usage USING (hemisphere, day_index) GROUP BY hemisphere, day_index, daily_max_temp_celsius, daily_rainfall_mm",
    ),
)
def temporal_panel(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    return pr.temporal_panel(p.usage, p.environment)


@query("C11_usage_by_landscape", box_sql("stats", LANDSCAPE_CELLS, "landscape_type"))
def usage_by_landscape(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    traits = materialise(pr.traits_with_means(p.household, p.usage), "traits")
    return pr.box_summary(traits, "landscape_type", ["mean_daily_water_usage"])


@query(
    "C12_feature_by_cluster",
    box_sql(
        "scored",
        "cells AS (" + " UNION ALL ".join(
            f"SELECT f.hemisphere, cluster_id, '{c}' AS \"column\", {c} AS value FROM feat f JOIN scored s "
            "ON f.hemisphere = s.hemisphere AND f.household_id = s.household_id" for c in FINAL_FEATURES
        ) + ")",
        "cluster_id",
    ),
)
def feature_by_cluster(spark, sf_dir):
    final = t.stored_final(spark, sf_dir)
    labels = score_profiles(final, t.class_scorer(spark, sf_dir, final)).select(*KEYS, "cluster_id")
    unscaled = t.stored_features(spark, sf_dir).select(*KEYS, *FINAL_FEATURES).join(labels, list(KEYS))
    return pr.box_summary(materialise(unscaled, "labelled"), "cluster_id", FINAL_FEATURES)


@query("C13_traits_and_means", with_tables("stats", f"SELECT {_HID}, {r(*_NUMERIC)} FROM traits", _TRAITS))
def traits_and_means(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    return pr.traits_with_means(p.household, p.usage).select(
        *KEYS, F.col("occupancy_count").cast("double").alias("occupancy_count"), *_NUMERIC[1:]
    )


@query("C9_usage_gamma_line")
def usage_gamma_line(spark, sf_dir):
    return density.qq_line(density.gamma_qq(t.stored_usage(spark, sf_dir), ["liters"], ["household_id", "day_index"]))
