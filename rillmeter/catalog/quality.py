"""Q: data-quality gates."""

from pyspark.sql import functions as F

from rillmeter.catalog import tables as t
from rillmeter.catalog.registry import query
from rillmeter.catalog.sql import r, with_tables
from rillmeter.functions.hemispheres import LANDSCAPE_WEIGHTS, PARAMETERS
from rillmeter.operators import quality as q
from rillmeter.session import scratch_path
from rillmeter.sources import layout

# Sizes of the full-size inputs; smaller data violates them, which the report shows.
EXPECTED = q.Expectations(households=100_000, days=365)


def _both(name):
    return f"CASE hemisphere WHEN 'north' THEN {PARAMETERS['north'][name]}::DOUBLE ELSE {PARAMETERS['south'][name]}::DOUBLE END"


def _check(check_id, severity, observed, expected, n_bad, source):
    text = "CAST(NULL AS VARCHAR)" if expected is None else expected if expected.startswith("CASE") else f"'{expected}'"
    return (
        f"SELECT hemisphere, '{check_id}' AS check_id, '{severity}' AS severity, {r(observed=f'CAST({observed} AS DOUBLE)')}, "
        f"{text} AS expected, CAST({n_bad} AS BIGINT) AS n_bad FROM {source} GROUP BY hemisphere"
    )


def _union(*checks):
    return with_tables("panel", " UNION ALL ".join(checks))


def _off(observed, name):
    return f"CASE WHEN abs({observed} - {_both(name)}) / {_both(name)} > 0.15 THEN 1 ELSE 0 END"


def _only(report, *prefixes):
    condition = F.lit(False)
    for p in prefixes:
        condition = condition | F.col("check_id").startswith(p)
    return report.where(condition)


def _household(spark, sf_dir):
    return q.check_household(t.panel(spark, sf_dir).household, EXPECTED)


def _environment(spark, sf_dir):
    return q.check_environment(t.panel(spark, sf_dir).environment, EXPECTED)


def _usage(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    return q.check_usage(p.usage, p.household, EXPECTED)


def _reports(*makers):
    def whole(spark, sf_dir):
        out = makers[0](spark, sf_dir)
        for make in makers[1:]:
            out = out.unionByName(make(spark, sf_dir))
        return out

    return whole


def _gate(name, prefixes, sql, *makers):
    report = _reports(*makers)
    query(name, sql)(lambda spark, sf_dir: _only(report(spark, sf_dir), *prefixes))


_PER_HOUSEHOLD = "(SELECT hemisphere, household_id, count(*) AS cells, count(DISTINCT day_index) AS days FROM usage GROUP BY 1, 2)"

_gate(
    "Q1_row_counts", ["Q1_"],
    _union(
        _check("Q1_households", "error", "count(*)", "100000", "abs(count(*) - 100000)", "household"),
        _check("Q1_days", "error", "count(*)", "365", "abs(count(*) - 365)", "environment"),
        _check("Q1_usage_days", "error", "sum(days)", "365 per household", "count(*) FILTER (WHERE days <> 365)", _PER_HOUSEHOLD),
        _check("Q1_usage_households", "error", "count(*)", "100000", "abs(count(*) - 100000)", _PER_HOUSEHOLD),
    ),
    _household, _environment, _usage,
)
_gate(
    "Q2_non_negative_usage", ["Q2_"],
    _union(_check("Q2_non_negative", "error", "min(liters)", ">= 0", "count(*) FILTER (WHERE liters < 0)", "usage")),
    _usage,
)
_BAD_OCCUPANCY = "count(*) FILTER (WHERE occupancy_count NOT BETWEEN 1 AND 8)"
_gate(
    "Q3_occupancy_range", ["Q3_"],
    _union(
        _check("Q3_occupancy_min", "error", "min(occupancy_count)", "1..8", _BAD_OCCUPANCY, "household"),
        _check("Q3_occupancy_max", "error", "max(occupancy_count)", "1..8", _BAD_OCCUPANCY, "household"),
    ),
    _household,
)
_CROSS = (
    "(SELECT h.hemisphere, households, metered, usage_days, environment_days FROM "
    "(SELECT hemisphere, count(*) AS households FROM household GROUP BY 1) h JOIN "
    f"(SELECT hemisphere, count(*) AS metered, max(days) AS usage_days FROM {_PER_HOUSEHOLD} GROUP BY 1) u USING (hemisphere) JOIN "
    "(SELECT hemisphere, count(*) AS environment_days FROM environment GROUP BY 1) e USING (hemisphere))"
)


def _cross(check_id, observed, expected, n_bad):
    return (
        f"SELECT hemisphere, '{check_id}' AS check_id, 'error' AS severity, CAST({observed} AS DOUBLE) AS observed, "
        f"CAST({expected} AS VARCHAR) AS expected, CAST({n_bad} AS BIGINT) AS n_bad FROM {_CROSS}"
    )


query(
    "Q4_cross_integrity",
    _union(
        _cross("Q4_household_count", "metered", "households", "abs(metered - households)"),
        _cross("Q4_environment_days", "environment_days", "365", "abs(environment_days - 365)"),
        _cross("Q4_usage_days", "usage_days", "365", "abs(usage_days - 365)"),
        _cross("Q4_orphans", "abs(metered - households)", "0", "abs(metered - households)"),
    ),
)(lambda spark, sf_dir: q.check_integrity(t.panel(spark, sf_dir), EXPECTED))

_TEMP, _RAIN = "daily_max_temp_celsius", "daily_rainfall_mm"
_gate(
    "Q5_temperature_bounds", ["Q5_"],
    _union(
        _check("Q5_temp_rows", "error", "count(*)", "365", "abs(count(*) - 365)", "environment"),
        _check("Q5_temp_min", "error", f"min({_TEMP})", "hemisphere bound", f"count(*) FILTER (WHERE {_TEMP} < {_both('temp_lower')})", "environment"),
        _check("Q5_temp_max", "error", f"max({_TEMP})", "hemisphere bound", f"count(*) FILTER (WHERE {_TEMP} > {_both('temp_upper')})", "environment"),
    ),
    _environment,
)
_NULLS = f"count(*) * 3 - count(day_index) - count({_TEMP}) - count({_RAIN})"
_gate(
    "Q6_nulls_and_days", ["Q6_"],
    _union(
        _check("Q6_nulls", "error", _NULLS, "0", _NULLS, "environment"),
        _check("Q6_first_day", "error", "min(day_index)", "0", "CASE WHEN min(day_index) <> 0 THEN 1 ELSE 0 END", "environment"),
        _check("Q6_last_day", "error", "max(day_index)", "364", "CASE WHEN max(day_index) <> 364 THEN 1 ELSE 0 END", "environment"),
        _check("Q6_distinct_days", "error", "count(DISTINCT day_index)", "one row per day", "count(*) - count(DISTINCT day_index)", "environment"),
    ),
    _environment,
)
_gate(
    "Q7_rain_range", ["Q7_"],
    _union(
        _check("Q7_rain_rows", "error", "count(*)", "365", "abs(count(*) - 365)", "environment"),
        _check("Q7_rain_min", "error", f"min({_RAIN})", ">= 0", f"count(*) FILTER (WHERE {_RAIN} < 0)", "environment"),
        _check("Q7_rain_max", "error", f"max({_RAIN})", "<= 75", f"count(*) FILTER (WHERE {_RAIN} > 75)", "environment"),
    ),
    _environment,
)
_gate(
    "Q8_wet_and_dry_days", ["Q8_"],
    _union(
        _check("Q8_wet_floor", "error", f"min({_RAIN}) FILTER (WHERE {_RAIN} > 0)", ">= 0.1", f"count(*) FILTER (WHERE {_RAIN} > 0 AND {_RAIN} < 0.1)", "environment"),
        _check("Q8_dry_exact", "error", f"max({_RAIN}) FILTER (WHERE NOT {_RAIN} > 0)", "0", f"count(*) FILTER (WHERE NOT {_RAIN} > 0 AND {_RAIN} <> 0)", "environment"),
    ),
    _environment,
)
_gate(
    "Q9_weather_statistics", ["Q9_"],
    _union(
        _check("Q9_wet_fraction", "info", f"avg(CASE WHEN {_RAIN} > 0 THEN 1.0::DOUBLE ELSE 0 END)", None, "0", "environment"),
        _check("Q9_wet_mean", "info", f"avg({_RAIN}) FILTER (WHERE {_RAIN} > 0)", None, "0", "environment"),
        _check("Q9_rain_mean", "info", f"avg({_RAIN})", None, "0", "environment"),
        _check("Q9_temp_min", "info", f"min({_TEMP})", None, "0", "environment"),
        _check("Q9_temp_max", "info", f"max({_TEMP})", None, "0", "environment"),
        _check("Q9_rain_min", "info", f"min({_RAIN})", None, "0", "environment"),
        _check("Q9_rain_max", "info", f"max({_RAIN})", None, "0", "environment"),
    ),
    _environment,
)
_EMPTY = "count(*) FILTER (WHERE household_id IS NULL OR length(CAST(household_id AS VARCHAR)) = 0)"
_gate(
    "Q10_household_ids", ["Q10_"],
    _union(
        _check("Q10_unique_ids", "error", "count(DISTINCT household_id)", "one per row", "count(*) - count(DISTINCT household_id)", "household"),
        _check("Q10_non_empty_ids", "error", _EMPTY, "0", _EMPTY, "household"),
        _check("Q10_id_count", "error", "count(*)", "100000", "abs(count(*) - 100000)", "household"),
    ),
    _household,
)
_gate(
    "Q11_occupancy_mean", ["Q11_"],
    _union(_check("Q11_occupancy_mean", "warn", "avg(occupancy_count)", "within 15%", _off("avg(occupancy_count)", "occupancy_mean"), "household")),
    _household,
)
_EFF = "appliance_efficiency_score"
_BAD_EFF = f"count(*) FILTER (WHERE {_EFF} < 0.15 OR {_EFF} > 0.95)"
_gate(
    "Q12_efficiency", ["Q12_"],
    _union(
        _check("Q12_efficiency_min", "error", f"min({_EFF})", "0.15..0.95", _BAD_EFF, "household"),
        _check("Q12_efficiency_max", "error", f"max({_EFF})", "0.15..0.95", _BAD_EFF, "household"),
        _check("Q12_efficiency_nan", "error", f"count(*) FILTER (WHERE {_EFF} IS NULL OR isnan({_EFF}))", "0", f"count(*) FILTER (WHERE {_EFF} IS NULL OR isnan({_EFF}))", "household"),
        _check("Q12_efficiency_mean", "warn", f"avg({_EFF})", "within 15%", _off(f"avg({_EFF})", "efficiency_mean"), "household"),
    ),
    _household,
)


def _share(label):
    north, south = LANDSCAPE_WEIGHTS["north"][label], LANDSCAPE_WEIGHTS["south"][label]
    weight = f"CASE hemisphere WHEN 'north' THEN {north}::DOUBLE ELSE {south}::DOUBLE END"
    share = f"(count(*) FILTER (WHERE landscape_type = '{label}') / count(*)::DOUBLE)"
    return _check(
        f"Q13_share_{label}", "warn", share, f"CASE hemisphere WHEN 'north' THEN '{north}' ELSE '{south}' END",
        f"CASE WHEN abs({share} - {weight}) / {weight} > 0.15 THEN 1 ELSE 0 END", "household",
    )


_UNKNOWN = f"count(*) FILTER (WHERE landscape_type NOT IN ({', '.join(repr(x) for x in LANDSCAPE_WEIGHTS['north'])}))"
_gate(
    "Q13_landscape", ["Q13_"],
    _union(_check("Q13_unknown_labels", "error", _UNKNOWN, "0", _UNKNOWN, "household"), *[_share(x) for x in LANDSCAPE_WEIGHTS["north"]]),
    lambda spark, sf_dir: q.check_landscape(t.panel(spark, sf_dir).household),
)
_FLOOR = (
    "(SELECT u.*, h.occupancy_count FROM usage u LEFT JOIN household h ON u.hemisphere = h.hemisphere AND u.household_id = h.household_id)"
)
_gate(
    "Q14_usage_matrix", ["Q14_"],
    _union(
        _check("Q14_usage_shape", "error", "sum(cells)", "one cell per household and day", "sum(cells) - sum(days)", _PER_HOUSEHOLD),
        _check("Q14_missing", "error", "count(*) - count(liters)", "0", "count(*) - count(liters)", "usage"),
        _check("Q14_not_finite", "error", "count(*) FILTER (WHERE NOT isfinite(liters))", "0", "count(*) FILTER (WHERE NOT isfinite(liters))", "usage"),
        _check("Q14_floor", "error", "min(liters)", ">= occupancy x intake", f"count(DISTINCT household_id) FILTER (WHERE liters < occupancy_count * {_both('intake_liters')} - 1e-5)", _FLOOR),
    ),
    _usage,
)
_LABELS = "(SELECT hemisphere, landscape_type, count(*) AS n FROM household GROUP BY 1, 2)"
_gate(
    "Q15_statistics", ["Q15_"],
    _union(
        _check("Q15_occupancy_std", "info", "stddev_pop(occupancy_count)", None, "0", "household"),
        _check("Q15_efficiency_std", "info", f"stddev_pop({_EFF})", None, "0", "household"),
        _check("Q15_landscape_labels", "info", "count(DISTINCT landscape_type)", None, "0", "household"),
        _check("Q15_landscape_mode_share", "info", "max(n) / sum(n)::DOUBLE", None, "0", _LABELS),
        _check("Q15_usage_mean", "info", "avg(liters)", None, "0", "usage"),
        _check("Q15_usage_std", "info", "stddev_pop(liters)", None, "0", "usage"),
        _check("Q15_usage_min", "info", "min(liters)", None, "0", "usage"),
        _check("Q15_usage_max", "info", "max(liters)", None, "0", "usage"),
    ),
    _household, lambda spark, sf_dir: q.check_landscape(t.panel(spark, sf_dir).household), _usage,
)


@query(
    "Q15_landscape_mode",
    with_tables(
        "panel",
        f"SELECT hemisphere, landscape_type AS mode FROM {_LABELS} QUALIFY row_number() OVER (PARTITION BY hemisphere ORDER BY n DESC, landscape_type) = 1",
    ),
)
def landscape_mode(spark, sf_dir):
    return q.landscape_mode(t.panel(spark, sf_dir).household)


def _types(table, *columns):
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS \"column\", '{d}' AS declared, '{d}' AS found, true AS conforms" for c, d in columns
    )


@query(
    "Q16_declared_types",
    " UNION ALL ".join(
        [
            _types("household", ("hemisphere", "string"), ("household_id", "string"), ("occupancy_count", "smallint"),
                   ("appliance_efficiency_score", "float"), ("landscape_type", "string")),
            _types("environment", ("hemisphere", "string"), ("day_index", "int"), (_TEMP, "float"), (_RAIN, "float")),
            _types("usage", ("hemisphere", "string"), ("household_id", "string"), ("day_index", "int"), ("liters", "float")),
        ]
    ),
)
def declared_types(spark, sf_dir):
    inputs = layout.load_inputs(spark, t.positional_copy(spark, sf_dir))
    return (
        q.check_types("household", inputs.household)
        .unionByName(q.check_types("environment", inputs.environment))
        .unionByName(q.check_types("usage", inputs.usage))
    )


_FOUND = "CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(typeof({c})) END"


def _stored(table, *columns):
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{table}' AS table_name, '{c}' AS \"column\", '{d}' AS declared, {_FOUND.format(c=c)} AS found, "
        f"{_FOUND.format(c=c)} = '{d}' AS conforms FROM {table}" for c, d in columns
    )


@query(
    "Q16_file_types",
    with_tables(
        "panel",
        " UNION ALL ".join(
            [
                _stored("household", ("household_id", "string"), ("occupancy_count", "smallint"), ("appliance_efficiency_score", "float"),
                        ("landscape_type", "string")),
                _stored("environment", ("day_index", "int"), (_TEMP, "float"), (_RAIN, "float")),
                _stored("usage", ("household_id", "string"), ("day_index", "int"), ("liters", "float")),
            ]
        ),
    ),
)
def file_types(spark, sf_dir):
    """Types in the part files of the panel as it is stored, in which keys are numbers and readings double precision."""
    p = t.panel(spark, sf_dir)
    checked = []
    for name, df in (("household", p.household), ("environment", p.environment), ("usage", p.usage)):
        path = scratch_path(spark, name)
        layout.write_keyed(df, path)
        checked.append(q.check_file_types(name, layout.read_keyed(spark, path)))
    household, environment, usage = checked
    return household.union(environment).union(usage).drop("file").distinct()
