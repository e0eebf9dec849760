"""Column profiles, univariate summaries, box summaries and the temporal panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmeter.functions.calendar import is_weekend
from rillmeter.functions.expressions import names_of, nan_to_null
from rillmeter.operators.ranking import DIRECT_ROWS, melt, quantile_table
from rillmeter.schemas import KEYS
from rillmeter.session import pin_small

# Percentiles of the univariate summary.
SUMMARY_PERCENTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)
# Whiskers reach this many interquartile ranges beyond the box.
WHISKER_REACH = 1.5


def value_counts(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Occurrences of every distinct value; repeated values combine before the shuffle."""
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def most_frequent(value: str, count: str = "n") -> Column:
    """The most frequent value over a table of value counts; the smallest of ties."""
    known = F.when(F.col(value).isNotNull(), F.col(count))
    return F.max_by(value, F.when(known.isNotNull(), F.struct(known, -F.col(value))))


def _is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def _cells(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per cell: numbers in ``value``, everything else in ``text``; NULLs kept, NaN is NULL."""
    numeric = {f.name for f in df.schema.fields if _is_numeric(f)}
    values = ", ".join(f"CAST(`{c}` AS DOUBLE)" if c in numeric else "CAST(NULL AS DOUBLE)" for c in columns)
    texts = ", ".join("CAST(NULL AS STRING)" if c in numeric else f"CAST(`{c}` AS STRING)" for c in columns)
    cells = df.select(*by, F.posexplode(F.expr(f"array({values})")).alias("i", "value"), F.expr(f"array({texts})").alias("texts"))
    return cells.select(
        *by, F.get(names_of(columns), F.col("i")).alias("column"), nan_to_null(F.col("value")).alias("value"), F.get("texts", F.col("i")).alias("text")
    )


def profile(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("hemisphere",), direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """One row per group and column: type, nulls, distinct values and, for numbers, moments.

    Distinct values and the mode come from value counts and the median from
    exact order statistics, so no task holds a whole column. ``n_unique``
    counts NULL as a value.
    """
    numeric = [f.name for f in df.schema.fields if f.name in columns and _is_numeric(f)]
    names = [*by, "column"]
    cells = _cells(df, by, columns)
    counted = value_counts(cells, [*names, "value", "text"])
    missing = F.col("value").isNull() & F.col("text").isNull()
    distinct = counted.groupBy(*names).agg(
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(F.lit(1)).alias("n_unique"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        most_frequent("value").alias("mode"),
    )
    moments = cells.groupBy(*names).agg(
        F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.stddev_samp("value").alias("std")
    )
    median = quantile_table(df, by, numeric, [0.5], direct_rows).select(
        *names, F.col("quantiles")[0].alias("median")
    )
    types = F.map_from_arrays(names_of(columns), names_of(df.schema[c].dataType.simpleString() for c in columns))
    return (
        distinct.join(moments, names)
        .join(median, names, "left")
        .select(
            *names, types[F.col("column")].alias("dtype"), "null_count", "n_unique",
            "min", "max", "mean", "median", "mode", "variance", "std",
        )
    )


def univariate_summary(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("hemisphere",), direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """Population moments, mode, exact percentiles, null and distinct counts per column.

    Skewness and excess kurtosis are the biased estimators; both are NULL for a
    constant column.
    """
    names = [*by, "column"]
    cells = _cells(df, by, columns).drop("text")
    distinct = value_counts(cells, [*names, "value"]).groupBy(*names).agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(F.lit(1)).alias("unique_values"),
        most_frequent("value").alias("mode"),
    )
    moments = cells.groupBy(*names).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    percentiles = quantile_table(df, by, columns, SUMMARY_PERCENTILES, direct_rows)
    picked = {f"p{round(p * 100):02d}": F.col("quantiles")[i] for i, p in enumerate(SUMMARY_PERCENTILES)}
    percentiles = percentiles.withColumns(picked).withColumn("median", F.col("p50")).drop("quantiles")
    return moments.join(distinct, names).join(percentiles, names)


def box_summary(
    df: DataFrame, category: str, columns: Sequence[str], by: Sequence[str] = ("hemisphere",),
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """Box-plot data per category: quartiles, whiskers within 1.5 IQR, outlier count."""
    groups = [*by, category]
    names = [*groups, "column"]
    box = quantile_table(df, groups, columns, [0.25, 0.5, 0.75], direct_rows).select(
        *names,
        F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"),
    )
    reach = F.lit(WHISKER_REACH) * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    cells = melt(df, groups, columns)
    # One row per category and column: a handful, bounded where it was made.
    return (
        cells.join(F.broadcast(box), names)
        .groupBy(*names, "q1", "median", "q3")
        .agg(
            F.count("value").alias("n"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def daily_means(usage: DataFrame) -> DataFrame:
    """Mean litres per hemisphere and day over all households."""
    return usage.groupBy("hemisphere", "day_index").agg(F.avg("liters").alias("mean_liters"))


def temporal_panel(usage: DataFrame, environment: DataFrame) -> DataFrame:
    """Weather next to mean usage, one row per hemisphere and day."""
    return environment.join(daily_means(usage), ["hemisphere", "day_index"])


def usage_means(usage: DataFrame) -> DataFrame:
    """Per household: mean over all, weekend and working days."""
    weekend = is_weekend(F.col("day_index"))
    return usage.groupBy(*KEYS).agg(
        F.avg("liters").alias("mean_daily_water_usage"),
        F.avg(F.when(weekend, F.col("liters"))).alias("weekend_mean"),
        F.avg(F.when(~weekend, F.col("liters"))).alias("weekday_mean"),
    )


def traits_with_means(household: DataFrame, usage: DataFrame) -> DataFrame:
    """Household traits with the three usage means alongside."""
    return household.join(usage_means(usage), list(KEYS))


def category_shares(df: DataFrame, category: str, by: Sequence[str] = ("hemisphere",)) -> DataFrame:
    """Relative frequency of each category within its group."""
    counts = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(pin_small(totals), list(by)).select(
        *by, category, "n", (F.col("n") / F.col("total")).alias("share")
    )
