"""A: aggregations."""

from pyspark.sql import functions as F

from rillmeter.catalog import tables as t
from rillmeter.catalog.registry import query
from rillmeter.catalog.sql import CORRELATION, long_of, r, with_tables
from rillmeter.functions.expressions import array_of
from rillmeter.operators import profile as pr
from rillmeter.operators.features import correlation_of
from rillmeter.operators.ranking import quantile_table
from rillmeter.schemas import FEATURES, KEYS

_HID = "hemisphere, household_id"


def _per_household(*names):
    table = t.statistics if {"p25", "p95"} & set(names) else t.moments

    def build(spark, sf_dir):
        return table(spark, sf_dir).select(*KEYS, *names)

    return build


_MASKED = ("dry_mean", "wet_mean", "weekend_mean", "weekday_mean", "summer_mean", "winter_mean", "drought_mean")

for _name, _columns in {
    "A1_household_mean": ("mean_usage",),
    "A2_household_std": ("std_usage",),
    "A3_masked_means": _MASKED,
    "A5_household_percentiles": ("p25", "p95"),
}.items():
    query(_name, with_tables("stats", f"SELECT {_HID}, {r(*_columns)} FROM stats"))(_per_household(*_columns))


@query("A4_temperature_correlation", with_tables("stats", f"SELECT {_HID}, {r(correlation=CORRELATION)} FROM stats"))
def temperature_correlation(spark, sf_dir):
    r_ = correlation_of(F.col("temp_covariance"), F.col("std_usage"), F.col("temp_std"))
    return t.moments(spark, sf_dir).select(*KEYS, r_.alias("correlation"))


@query("A6_daily_mean", with_tables("panel", f"SELECT hemisphere, day_index, {r(mean_liters='avg(liters)')} FROM usage GROUP BY 1, 2"))
def daily_mean(spark, sf_dir):
    return pr.daily_means(t.panel(spark, sf_dir).usage)


_TRAITS = ("occupancy_count", "appliance_efficiency_score")
TRAIT_LONG = f"cells AS ({long_of('household', _TRAITS)})"
USAGE_LONG = "cells AS (SELECT hemisphere, household_id, 'liters' AS \"column\", liters AS value FROM usage)"
FEATURE_CELLS = f"cells AS ({long_of('feat', FEATURES)})"
# The most frequent value, the smallest of ties.
MODES = (
    "modes AS (SELECT hemisphere, \"column\", value AS mode FROM (SELECT hemisphere, \"column\", value, count(*) AS n FROM cells "
    "WHERE value IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY hemisphere, \"column\" ORDER BY n DESC, value) = 1)"
)


def trait_profile(spark, sf_dir):
    return pr.profile(t.panel(spark, sf_dir).household, [*_TRAITS, "landscape_type"])


@query(
    "A7_column_moments",
    with_tables(
        "panel",
        'SELECT hemisphere, "column", '
        + r(
            min="min(value)", max="max(value)", mean="avg(value)", median="median(value)",
            variance="var_samp(value)", std="stddev_samp(value)",
        )
        + " FROM cells GROUP BY 1, 2",
        TRAIT_LONG,
    ),
)
def column_moments(spark, sf_dir):
    numbers = trait_profile(spark, sf_dir).where(F.col("column") != "landscape_type")
    return numbers.select("hemisphere", "column", "min", "max", "mean", "median", "variance", "std")


_COUNTS = " UNION ALL ".join(
    f"SELECT hemisphere, '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
    f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n_unique FROM household GROUP BY 1"
    for c in (*_TRAITS, "landscape_type")
)


@query("A8_null_and_distinct", with_tables("panel", _COUNTS))
def null_and_distinct(spark, sf_dir):
    return trait_profile(spark, sf_dir).select("hemisphere", "column", "null_count", "n_unique")


@query("A9_mode", with_tables("panel", f'SELECT hemisphere, "column", {r("mode")} FROM modes', USAGE_LONG, MODES))
def mode(spark, sf_dir):
    names = ["hemisphere", "column", "value"]
    cells = t.panel(spark, sf_dir).usage.select("hemisphere", F.lit("liters").alias("column"), F.col("liters").alias("value"))
    return pr.value_counts(cells, names).groupBy("hemisphere", "column").agg(pr.most_frequent("value").alias("mode"))


MOMENTS = (
    "centred AS (SELECT *, value - avg(value) OVER (PARTITION BY hemisphere, \"column\") AS d FROM cells)"
)
SKEWNESS = "CASE WHEN avg(d * d) = 0 THEN NULL ELSE avg(d * d * d) / pow(avg(d * d), 1.5) END"
KURTOSIS = "CASE WHEN avg(d * d) = 0 THEN NULL ELSE avg(d * d * d * d) / pow(avg(d * d), 2) - 3 END"


@query(
    "A10_skewness_kurtosis",
    with_tables(
        "panel", f"SELECT hemisphere, {r(skewness=SKEWNESS, kurtosis=KURTOSIS)} FROM centred GROUP BY 1", USAGE_LONG, MOMENTS
    ),
)
def skewness_kurtosis(spark, sf_dir):
    return t.panel(spark, sf_dir).usage.groupBy("hemisphere").agg(
        F.skewness("liters").alias("skewness"), F.kurtosis("liters").alias("kurtosis")
    )


PERCENTILES = {f"p{round(p * 100):02d}": f"quantile_cont(value, {p})" for p in pr.SUMMARY_PERCENTILES}


@query("A11_percentiles", with_tables("panel", f"SELECT hemisphere, {r(**PERCENTILES)} FROM cells GROUP BY 1", USAGE_LONG))
def percentiles(spark, sf_dir):
    usage = t.stored_usage(spark, sf_dir)
    table = quantile_table(usage, ["hemisphere"], ["liters"], pr.SUMMARY_PERCENTILES)
    return table.select("hemisphere", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(PERCENTILES)])


@query(
    "A12_all",
    with_tables(
        "panel",
        "SELECT hemisphere, bool_and(daily_rainfall_mm >= 0) AS non_negative, bool_and(daily_rainfall_mm <= 75) AS under_cap, "
        "bool_and(daily_max_temp_celsius >= 9) AS above_nine FROM environment GROUP BY 1",
    ),
)
def all_hold(spark, sf_dir):
    return t.panel(spark, sf_dir).environment.groupBy("hemisphere").agg(
        F.bool_and(F.col("daily_rainfall_mm") >= 0).alias("non_negative"),
        F.bool_and(F.col("daily_rainfall_mm") <= 75).alias("under_cap"),
        F.bool_and(F.col("daily_max_temp_celsius") >= 9).alias("above_nine"),
    )


@query(
    "A13_null_sum",
    with_tables("panel", f"SELECT hemisphere, CAST({' + '.join(f'(count(*) - count(column_{d}))' for d in range(365))} AS BIGINT) AS null_cells "
    "FROM (SELECT h.hemisphere, h.household_id, "
    + ", ".join(f"max(liters) FILTER (WHERE day_index = {d}) AS column_{d}" for d in range(365))
    + " FROM household h LEFT JOIN usage u ON h.hemisphere = u.hemisphere AND h.household_id = u.household_id GROUP BY 1, 2) GROUP BY 1"),
)
def null_sum(spark, sf_dir):
    from rillmeter.catalog.sources import usage_matrix
    from rillmeter.sources.layout import day_columns

    matrix = usage_matrix(spark, sf_dir)
    cells = matrix.select("hemisphere", F.explode(array_of(day_columns(matrix.columns), "FLOAT")).alias("liters"))
    return cells.groupBy("hemisphere").agg(F.count_if(F.col("liters").isNull()).alias("null_cells"))


@query(
    "A14_category_shares",
    with_tables(
        "panel",
        "SELECT hemisphere, landscape_type, n, " + r(share="n / sum(n) OVER (PARTITION BY hemisphere)")
        + " FROM (SELECT hemisphere, landscape_type, count(*) AS n FROM household GROUP BY 1, 2)",
    ),
)
def category_shares(spark, sf_dir):
    return pr.category_shares(t.panel(spark, sf_dir).household, "landscape_type")


@query(
    "A15_uniqueness",
    with_tables(
        "panel",
        "SELECT hemisphere, count(*) AS n_rows, count(DISTINCT household_id) AS n_ids, count(*) = count(DISTINCT household_id) AS is_unique "
        "FROM household GROUP BY 1",
    ),
)
def uniqueness(spark, sf_dir):
    ids, rows = F.count_distinct("household_id"), F.count(F.lit(1))
    return t.panel(spark, sf_dir).household.groupBy("hemisphere").agg(
        rows.alias("n_rows"), ids.alias("n_ids"), (ids == rows).alias("is_unique")
    )


def box_sql(level: str, cells: str, category: str) -> str:
    """Box summary of ``cells(hemisphere, <category>, column, value)``."""
    keys = f'hemisphere, {category}, "column"'
    return with_tables(
        level,
        f"SELECT {keys}, {r('q1', 'median', 'q3')}, count(value) AS n, "
        + r(
            whisker_low="min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))",
            whisker_high="max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))",
        )
        + ", count(*) FILTER (WHERE value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers "
        f"FROM cells JOIN box USING ({keys}) GROUP BY {keys}, q1, median, q3",
        cells,
        f"box AS (SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
        f"quantile_cont(value, 0.75) AS q3 FROM cells GROUP BY {keys})",
    )


LANDSCAPE_CELLS = (
    "cells AS (SELECT h.hemisphere, landscape_type, 'mean_daily_water_usage' AS \"column\", mean_usage AS value "
    "FROM household h JOIN stats s ON h.hemisphere = s.hemisphere AND h.household_id = s.household_id)"
)


@query("A16_box_summary", box_sql("stats", LANDSCAPE_CELLS, "landscape_type"))
def box_summary(spark, sf_dir):
    from rillmeter.session import materialise

    p = t.panel(spark, sf_dir)
    traits = materialise(pr.traits_with_means(p.household, p.usage), "traits")
    return pr.box_summary(traits, "landscape_type", ["mean_daily_water_usage"])
