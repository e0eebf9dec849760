"""Building blocks of the comparison SQL: the panel, its features and the fitted scalers as CTEs."""

from __future__ import annotations

from rillmeter.schemas import FEATURES, FINAL_FEATURES, POWER_COLUMNS, ROBUST_COLUMNS, SCALED_ORDER


def r(*names: str, digits: int = 6, **expressions: str) -> str:
    """Select items rounded for publication; negative zero becomes zero."""
    items = {n: n for n in names} | expressions
    return ", ".join(
        f"CASE WHEN round({e}, {digits}) = 0 THEN 0::DOUBLE ELSE round({e}, {digits}) END AS {n}" for n, e in items.items()
    )


HOUSEHOLD = """household AS (
  SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'north' ELSE 'south' END AS hemisphere,
         s_suppkey AS household_id,
         CAST(1 + s_suppkey % 8 AS INT) AS occupancy_count,
         CAST(0.15 + (s_suppkey % 81) / 100.0 AS DOUBLE) AS appliance_efficiency_score,
         CASE r_name WHEN 'AFRICA' THEN 'turfgrass_dominant' WHEN 'AMERICA' THEN 'hardscape_dominant'
                     WHEN 'ASIA' THEN 'container_balcony' WHEN 'EUROPE' THEN 'xeriscape_native'
                     ELSE 'food_homegarden' END AS landscape_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

USAGE = """usage AS (
  SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'north' ELSE 'south' END AS hemisphere,
         l_suppkey AS household_id, CAST(dayofyear(l_shipdate) - 1 AS INT) AS day_index,
         SUM(l_quantity) AS liters
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE dayofyear(l_shipdate) <= 365
  GROUP BY 1, 2, 3)"""

ENVIRONMENT = """environment AS (
  WITH d AS (SELECT DISTINCT CAST(dayofyear(l_shipdate) - 1 AS INT) AS day_index
             FROM lineitem WHERE dayofyear(l_shipdate) <= 365),
       h AS (SELECT 'north' AS hemisphere UNION ALL SELECT 'south')
  SELECT hemisphere, day_index,
         CASE WHEN hemisphere = 'north'
              THEN least(greatest(15.2 + 7.15 * sin(2 * pi() / 365 * (day_index - 30)), 7.0), 35.0)
              ELSE least(greatest(13.3 - 3.65 * sin(2 * pi() / 365 * (day_index - 40)), 9.0), 25.0)
         END AS daily_max_temp_celsius,
         CASE WHEN (day_index BETWEEN 150 AND 239 AND day_index % 13 = 0)
                OR (day_index NOT BETWEEN 150 AND 239 AND (day_index * 7) % 10 < 3)
              THEN CAST(0.1 + ((day_index * 31) % 200) / 10.0 AS DOUBLE)
              ELSE CAST(0 AS DOUBLE) END AS daily_rainfall_mm
  FROM d CROSS JOIN h)"""

FLAGS = """flags AS (
  SELECT *, bool_or(is_drought) OVER (PARTITION BY hemisphere) AS any_drought
  FROM (SELECT *, dry_in_window >= 6 AS is_drought
        FROM (SELECT hemisphere, day_index, daily_max_temp_celsius AS temp, daily_rainfall_mm < 0.1 AS is_dry,
                     day_index % 7 >= 5 AS is_weekend,
                     CASE WHEN hemisphere = 'north' THEN day_index BETWEEN 91 AND 273
                          ELSE NOT (day_index BETWEEN 91 AND 273) END AS is_summer,
                     CAST(sum(CASE WHEN daily_rainfall_mm < 0.1 THEN 1 ELSE 0 END)
                       OVER (PARTITION BY hemisphere ORDER BY day_index ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS BIGINT)
                       AS dry_in_window
              FROM environment)))"""

STATS = """stats AS (
  SELECT u.hemisphere, u.household_id, count(liters) AS n_days,
         avg(liters) AS mean_usage, stddev_pop(liters) AS std_usage,
         avg(liters) FILTER (WHERE is_dry) AS dry_mean, avg(liters) FILTER (WHERE NOT is_dry) AS wet_mean,
         avg(liters) FILTER (WHERE is_weekend) AS weekend_mean, avg(liters) FILTER (WHERE NOT is_weekend) AS weekday_mean,
         avg(liters) FILTER (WHERE is_summer) AS summer_mean, avg(liters) FILTER (WHERE NOT is_summer) AS winter_mean,
         avg(liters) FILTER (WHERE is_drought) AS drought_mean, bool_or(any_drought) AS any_drought,
         covar_pop(liters, temp) AS temp_covariance, stddev_pop(temp) AS temp_std,
         quantile_cont(liters, 0.25) AS p25, quantile_cont(liters, 0.95) AS p95
  FROM usage u JOIN flags f ON u.hemisphere = f.hemisphere AND u.day_index = f.day_index
  GROUP BY 1, 2)"""

COEFFICIENT = """CASE landscape_type WHEN 'turfgrass_dominant' THEN 1.0 WHEN 'hardscape_dominant' THEN 0.8
  WHEN 'container_balcony' THEN 0.6 WHEN 'xeriscape_native' THEN 0.3 WHEN 'food_homegarden' THEN 0.2 ELSE 0.5 END::DOUBLE"""

CORRELATION = "CASE WHEN std_usage * temp_std = 0 THEN NULL ELSE temp_covariance / (std_usage * temp_std) END"

FEATURE_SQL = {
    "log_per_capita_usage": "ln(1 + mean_usage / greatest(occupancy_count, 1))",
    "efficiency_penalty_ratio": "1 + (1 - appliance_efficiency_score)",
    "water_usage_cv": "CASE WHEN mean_usage > 0 THEN std_usage / mean_usage ELSE 0 END",
    "dry_day_spike_factor": "CASE WHEN wet_mean > 0 THEN dry_mean / wet_mean ELSE 1 END",
    "temp_sensitivity_corr": f"greatest(coalesce({CORRELATION}, 0), -0.5)",
    "weekend_weekday_ratio": "CASE WHEN weekday_mean > 0 AND weekend_mean IS NULL THEN NULL "
    "ELSE greatest(CASE WHEN weekday_mean > 0 THEN weekend_mean / weekday_mean ELSE 1 END, 0.75) END",
    "landscape_demand_index": COEFFICIENT,
    "seasonal_amplitude_ratio": "CASE WHEN winter_mean > 0 THEN summer_mean / winter_mean ELSE 1 END",
    "drought_responsiveness_index": "CASE WHEN NOT any_drought THEN 1 WHEN mean_usage > 0 THEN drought_mean / mean_usage ELSE 1 END",
    "baseline_peak_ratio": "CASE WHEN p95 > 0 THEN p25 / p95 ELSE 1 END",
}

FEATURES_CTE = (
    "feat AS (SELECT h.hemisphere, h.household_id, "
    + ", ".join(f"CAST({FEATURE_SQL[f]} AS DOUBLE) AS {f}" for f in FEATURES)
    + " FROM household h JOIN stats s ON h.hemisphere = s.hemisphere AND h.household_id = s.household_id)"
)


def long_of(table: str, columns, keys: str = "hemisphere, household_id") -> str:
    """Long form of a wide table."""
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {table}" for c in columns)


def yeo_johnson(x: str, lam: str) -> str:
    return (
        f"CASE WHEN {x} >= 0 THEN CASE WHEN abs({lam}) < 1e-15 THEN ln(1 + {x}) ELSE (pow(1 + {x}, {lam}) - 1) / ({lam}) END "
        f"ELSE CASE WHEN abs(2 - ({lam})) < 1e-15 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - ({lam})) - 1) / (2 - ({lam})) END END"
    )


ROBUST = (
    f"feature_long AS ({long_of('feat', FEATURES)}), "
    "robust AS (SELECT hemisphere, \"column\", CAST(NULL AS DOUBLE) AS \"lambda\", quantile_cont(value, 0.5) AS center, "
    "CASE WHEN quantile_cont(value, 0.95) - quantile_cont(value, 0.05) < 2.220446049250313e-15 THEN 1 "
    "ELSE quantile_cont(value, 0.95) - quantile_cont(value, 0.05) END AS scale FROM feature_long "
    f"WHERE \"column\" IN ({', '.join(repr(c) for c in ROBUST_COLUMNS)}) GROUP BY 1, 2)"
)


def _slope(x: str, lam: str) -> str:
    """Derivative of the transform by lambda."""
    gain, power = f"ln(1 + abs({x}))", f"(CASE WHEN {x} >= 0 THEN {lam} ELSE 2 - {lam} END)"
    return (
        f"CASE WHEN abs({power}) < 1e-15 THEN {gain} * {gain} / 2 "
        f"ELSE (pow(1 + abs({x}), {power}) * {gain} - (pow(1 + abs({x}), {power}) - 1) / {power}) / {power} END"
    )


_PASSES, _ZOOMS = 10, 3


def _power() -> str:
    """The lambda search: passes of 17 candidates that move outwards or narrow, then the zero of the derivative."""
    parts = [
        f"pv AS (SELECT * FROM feature_long WHERE value IS NOT NULL AND \"column\" IN ({', '.join(repr(c) for c in POWER_COLUMNS)}))",
        "b0 AS (SELECT DISTINCT hemisphere, \"column\", -2::DOUBLE AS low, 0.25::DOUBLE AS step FROM pv)",
    ]
    transformed = yeo_johnson("value", "low + j * step")
    for i in range(_PASSES):
        parts.append(
            f"l{i} AS MATERIALIZED (SELECT hemisphere, \"column\", low, step, j, -count(*) / 2.0 * ln(var_pop({transformed})) "
            f"+ (low + j * step - 1) * sum(sign(value) * ln(1 + abs(value))) AS ll "
            f"FROM b{i} JOIN pv USING (hemisphere, \"column\") CROSS JOIN (SELECT range AS j FROM range(17)) "
            "GROUP BY hemisphere, \"column\", low, step, j)"
        )
        if i < _PASSES - 1:
            parts.append(
                f"b{i + 1} AS (SELECT hemisphere, \"column\", CASE j WHEN 0 THEN low - 32 * step WHEN 16 THEN low + 15 * step "
                "ELSE CASE WHEN step <= 1e-3 THEN low ELSE low + (j - 1) * step END END AS low, "
                "CASE WHEN j IN (0, 16) THEN 33 * step / 16 WHEN step <= 1e-3 THEN step ELSE step / 8 END AS step "
                f"FROM l{i} QUALIFY row_number() OVER (PARTITION BY hemisphere, \"column\" ORDER BY ll DESC, j) = 1)"
            )
    # Where the likelihood's derivative is zero: three passes to the interval of its change of sign, then a line.
    lam = "(low + j * step)"
    y, slope = yeo_johnson("value", lam), _slope("value", lam)
    ordered = 'WINDOW w AS (PARTITION BY hemisphere, "column" ORDER BY j)'
    parts.append(
        f"z0 AS (SELECT hemisphere, \"column\", low + (j - 1) * step AS low, step / 8 AS step FROM l{_PASSES - 1} "
        "QUALIFY row_number() OVER (PARTITION BY hemisphere, \"column\" ORDER BY ll DESC, j) = 1)"
    )
    for i in range(_ZOOMS):
        parts.append(
            f"d{i} AS MATERIALIZED (SELECT hemisphere, \"column\", low, step, j, sum(sign(value) * ln(1 + abs(value))) "
            f"- count(*) * covar_pop({y}, {slope}) / var_pop({y}) AS slope FROM z{i} JOIN pv USING (hemisphere, \"column\") "
            "CROSS JOIN (SELECT range AS j FROM range(17)) GROUP BY hemisphere, \"column\", low, step, j), "
            f"e{i} AS (SELECT * FROM (SELECT *, lead(slope) OVER w AS after FROM d{i} {ordered}) WHERE slope > 0 AND after <= 0)"
        )
        if i < _ZOOMS - 1:
            parts.append(f"z{i + 1} AS (SELECT hemisphere, \"column\", low + j * step AS low, step / 16 AS step FROM e{i})")
    parts.append(f"lam AS (SELECT hemisphere, \"column\", low + (j + slope / (slope - after)) * step AS \"lambda\" FROM e{_ZOOMS - 1})")
    transformed = yeo_johnson("value", '"lambda"')
    parts.append(
        f"power AS MATERIALIZED (SELECT hemisphere, \"column\", \"lambda\", avg({transformed}) AS center, stddev_pop({transformed}) AS scale "
        "FROM pv JOIN lam USING (hemisphere, \"column\") GROUP BY 1, 2, 3)"
    )
    return ", ".join(parts)


def _scaled() -> str:
    columns = []
    for c in SCALED_ORDER:
        if c in POWER_COLUMNS:
            transformed = yeo_johnson(f"f.{c}", f"max(p.\"lambda\") FILTER (WHERE p.\"column\" = '{c}')")
            value = f"({transformed})"
        else:
            value = f"f.{c}"
        columns.append(
            f"({value} - max(p.center) FILTER (WHERE p.\"column\" = '{c}')) / max(p.scale) FILTER (WHERE p.\"column\" = '{c}') AS {c}"
        )
    names = ", ".join(f"f.{c}" for c in SCALED_ORDER)
    return (
        "params AS (SELECT * FROM robust UNION ALL SELECT * FROM power), "
        f"scaled AS (SELECT f.hemisphere, f.household_id, {', '.join(columns)} FROM feat f JOIN params p ON f.hemisphere = p.hemisphere "
        f"GROUP BY f.hemisphere, f.household_id, {names})"
    )


# Centroids of four occupancy classes stand in for fitted ones: data-derived and the same in every engine.
CENTROIDS = (
    "centroids AS (SELECT s.hemisphere, CAST((occupancy_count - 1) // 2 AS INT) AS cluster_id, "
    + ", ".join(f"avg({f}) AS {f}" for f in FINAL_FEATURES)
    + " FROM scaled s JOIN household h ON s.hemisphere = h.hemisphere AND s.household_id = h.household_id GROUP BY 1, 2)"
)
_GAPS = " + ".join(f"pow(s.{f} - c.{f}, 2)" for f in FINAL_FEATURES)
DISTANCES = (
    f"gaps AS (SELECT s.hemisphere, s.household_id, c.cluster_id, sqrt({_GAPS}) AS distance "
    "FROM scaled s JOIN centroids c ON s.hemisphere = c.hemisphere), "
    "scored AS (SELECT hemisphere, household_id, CAST(arg_min(cluster_id, distance) AS VARCHAR) AS cluster_id, min(distance) AS min_distance, "
    + ", ".join(f"max(distance) FILTER (WHERE cluster_id = {i}) AS distance_{i}" for i in range(4))
    + " FROM gaps GROUP BY 1, 2)"
)
ARCHETYPES = (
    "named AS (SELECT c.hemisphere, c.cluster_id, CASE WHEN c.cluster_id = lowest THEN 'Conservationists (Low Volume)' "
    "WHEN c.cluster_id = highest THEN 'Heavy Users (High Volume)' WHEN c.cluster_id = outdoor THEN 'Outdoor/Landscape Heavy' "
    "ELSE 'Standard Average Consumers' END AS archetype FROM centroids c JOIN "
    "(SELECT hemisphere, arg_min(cluster_id, log_per_capita_usage) AS lowest, arg_max(cluster_id, log_per_capita_usage) AS highest "
    "FROM centroids GROUP BY 1) e USING (hemisphere) JOIN "
    "(SELECT hemisphere, arg_max(cluster_id, landscape_demand_index) AS outdoor FROM "
    "(SELECT *, rank() OVER (PARTITION BY hemisphere ORDER BY log_per_capita_usage) AS up, "
    "rank() OVER (PARTITION BY hemisphere ORDER BY log_per_capita_usage DESC) AS down FROM centroids) WHERE up > 1 AND down > 1 GROUP BY 1) o "
    "USING (hemisphere))"
)

DEMAND = """params_d AS (
  SELECT 'north' AS hemisphere, 15.2::DOUBLE AS temp_mean, 7.15::DOUBLE AS amp, 30 AS phase, 0.20::DOUBLE AS k, 11.35::DOUBLE AS t0,
         1.45::DOUBLE AS weekend, 2.725::DOUBLE AS intake, 200::DOUBLE AS per_capita, 115::DOUBLE AS yard
  UNION ALL SELECT 'south', 13.3, -3.65, 40, 0.39, 11.33, 1.3, 2.35, 150, 85),
expected AS (
  SELECT *, greatest(indoor_liters + outdoor_liters, occupancy_count * intake) AS expected_liters
  FROM (SELECT h.hemisphere, h.household_id, e.day_index, occupancy_count, intake,
               greatest(greatest(daily_max_temp_celsius - temp_mean, 0) - daily_rainfall_mm, 0.5) AS deficit,
               (intake + occupancy_count * CASE WHEN e.day_index % 7 >= 5 THEN weekend ELSE 1 END * per_capita)
                 * (2 - appliance_efficiency_score) AS indoor_liters,
               greatest(greatest(daily_max_temp_celsius - temp_mean, 0) - daily_rainfall_mm, 0.5) * yard * """ + COEFFICIENT + """ AS outdoor_liters
        FROM household h JOIN environment e ON h.hemisphere = e.hemisphere JOIN params_d p ON h.hemisphere = p.hemisphere))"""

_LEVELS = {
    "panel": [HOUSEHOLD, USAGE, ENVIRONMENT],
    "flags": [HOUSEHOLD, USAGE, ENVIRONMENT, FLAGS],
    "stats": [HOUSEHOLD, USAGE, ENVIRONMENT, FLAGS, STATS],
    "features": [HOUSEHOLD, USAGE, ENVIRONMENT, FLAGS, STATS, FEATURES_CTE],
    "robust": [HOUSEHOLD, USAGE, ENVIRONMENT, FLAGS, STATS, FEATURES_CTE, ROBUST],
    "demand": [HOUSEHOLD, USAGE, ENVIRONMENT, DEMAND],
}
_LEVELS["scaled"] = [*_LEVELS["robust"], _power(), _scaled()]
_LEVELS["scored"] = [*_LEVELS["scaled"], CENTROIDS, DISTANCES, ARCHETYPES]


def with_tables(level: str, query: str, *extra: str) -> str:
    """``query`` preceded by the CTEs of ``level`` and any further ones."""
    return f"WITH {', '.join([*_LEVELS[level], *extra])} {query}"
