"""D: expected demand."""

from rillmeter.catalog import tables as t
from rillmeter.catalog.registry import query
from rillmeter.catalog.sql import r, with_tables
from rillmeter.operators import demand
from rillmeter.schemas import KEYS

_HID = "hemisphere, household_id"
_CURVE = "round_even(temp_mean + amp * sin(2 * pi() / 365 * (day_index - phase)), 2)"


@query(
    "D1_seasonal_baseline",
    with_tables(
        "demand",
        f"SELECT hemisphere, day_index, {r(base_seasonal_temp_celsius=_CURVE, temp_anomaly_celsius=f'daily_max_temp_celsius - {_CURVE}')} "
        "FROM environment JOIN params_d USING (hemisphere)",
    ),
)
def seasonal_baseline(spark, sf_dir):
    out = demand.seasonal_baseline(t.panel(spark, sf_dir).environment)
    return out.select("hemisphere", "day_index", "base_seasonal_temp_celsius", "temp_anomaly_celsius")


@query(
    "D2_rain_probability",
    with_tables(
        "demand",
        f"SELECT hemisphere, day_index, {r(rain_probability='round_even(1 / (1 + exp(k * (daily_max_temp_celsius - t0))), 4)')} "
        "FROM environment JOIN params_d USING (hemisphere)",
    ),
)
def rain_probability(spark, sf_dir):
    return demand.rain_probability(t.panel(spark, sf_dir).environment).select("hemisphere", "day_index", "rain_probability")


def _expected(*names):
    def build(spark, sf_dir):
        p = t.panel(spark, sf_dir)
        return demand.expected_usage(p.household, p.environment, p.environment_rows).select(*KEYS, "day_index", *names)

    return build


for _id, _column in {"D3_indoor_demand": "indoor_liters", "D5_outdoor_demand": "outdoor_liters", "D6_expected_liters": "expected_liters"}.items():
    query(_id, with_tables("demand", f"SELECT {_HID}, day_index, {r(_column)} FROM expected"))(_expected(_column))


@query(
    "D4_deficit",
    with_tables(
        "demand",
        f"SELECT hemisphere, day_index, {r(deficit='greatest(greatest(daily_max_temp_celsius - temp_mean, 0) - daily_rainfall_mm, 0.5)')} "
        "FROM environment JOIN params_d USING (hemisphere)",
    ),
)
def deficit(spark, sf_dir):
    return demand.day_deficits(t.panel(spark, sf_dir).environment)


_RESIDUALS = (
    "residuals AS (SELECT u.hemisphere, u.household_id, u.day_index, liters, expected_liters, liters - expected_liters AS residual "
    "FROM usage u JOIN expected e ON u.hemisphere = e.hemisphere AND u.household_id = e.household_id AND u.day_index = e.day_index)"
)


def _residuals(spark, sf_dir):
    p = t.panel(spark, sf_dir)
    return demand.usage_residuals(p.household, p.usage, p.environment, p.environment_rows)


@query("D7_residuals", with_tables("demand", f"SELECT {_HID}, day_index, {r('liters', 'expected_liters', 'residual')} FROM residuals", _RESIDUALS))
def residuals(spark, sf_dir):
    return _residuals(spark, sf_dir)


@query(
    "D7_residual_summary",
    with_tables(
        "demand",
        f"SELECT {_HID}, "
        + r(residual_mean="avg(residual)", residual_std="stddev_pop(residual)", largest_abs_residual="max(abs(residual))")
        + f", first(day_index ORDER BY abs(residual) DESC, day_index) AS largest_day FROM residuals GROUP BY {_HID}",
        _RESIDUALS,
    ),
)
def residual_summary(spark, sf_dir):
    return demand.residual_summary(_residuals(spark, sf_dir))
