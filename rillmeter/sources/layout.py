"""Readers and writers.

Two layouts are understood. The *positional* one is three files per hemisphere
whose rows belong together by order: ``{hemisphere}_household.csv``,
``{hemisphere}_environment.csv`` (row = day) and
``{hemisphere}_water_usage.parquet`` (row = household, one column per day). The
*keyed* one is a folder of Parquet tables partitioned by hemisphere; work
happens there. A name may stand for one file or for a folder of part files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmeter.functions.expressions import array_of, clip
from rillmeter.schemas import ENVIRONMENT_SCHEMA, HEMISPHERES, HOUSEHOLD_SCHEMA, KEYS, Inputs
from rillmeter.session import materialise, pin_small

# Efficiency scores are clipped to this range on load.
EFFICIENCY_CLIP = (0.15, 1.0)
# Name pattern of the day columns.
DAY_COLUMN = re.compile(r"column_(\d+)$")
#: Most file splits whose row counts are gathered to number rows (40 TB at 128 MB each).
MAX_SPLITS = 320_000


def _number_rows(df: DataFrame, split: Sequence[Column], in_split: Column) -> DataFrame:
    """Add ``row_number``: the 0-based position over all files, in path and offset order.

    Rows are counted per split and the counts summed up, so no task sees more
    than its own split; what is gathered is one number per split.
    """
    names = [f"_split{i}" for i in range(len(split))]
    numbered = df.select("*", *[c.alias(n) for c, n in zip(split, names)], in_split.alias("_in_split"))
    # Rows of a split are numbered consecutively, though not from zero.
    sizes = numbered.groupBy(*names).agg(F.count(F.lit(1)).alias("_size"), F.min("_in_split").alias("_first"))
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    position = F.col("_before") + F.col("_in_split") - F.col("_first")
    return (
        numbered.join(pin_small(starts, MAX_SPLITS), names)
        .withColumn("row_number", position)
        .drop(*names, "_in_split", "_before", "_first")
    )


def _numbered_csv(df: DataFrame) -> DataFrame:
    """Where a file is split depends on the parallelism of the moment, so rows are stored with their place first."""
    places = {"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()}
    stored = materialise(df.select("*", *[place.alias(name) for name, place in places.items()]), "numbered")
    return _number_rows(stored, [F.col("_path"), F.col("_start")], F.col("_row")).drop(*places)


def _numbered_parquet(df: DataFrame) -> DataFrame:
    return _number_rows(df, [F.col("_metadata.file_path")], F.col("_metadata.row_index"))


def _csv(spark: SparkSession, schema, path: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def read_household(spark: SparkSession, base_dir: str, hemisphere: str, numbered: bool = False) -> DataFrame:
    """Household CSV with declared types; scores are clipped on load."""
    df = _csv(spark, HOUSEHOLD_SCHEMA, f"{base_dir}/{hemisphere}_household.csv")
    if numbered:
        df = _numbered_csv(df)
    score = clip(F.col("appliance_efficiency_score"), *EFFICIENCY_CLIP).cast("float")
    return df.withColumn("appliance_efficiency_score", score).select(F.lit(hemisphere).alias("hemisphere"), "*")


def read_environment(spark: SparkSession, base_dir: str, hemisphere: str) -> DataFrame:
    """Environment CSV; the day is the row's position."""
    df = _numbered_csv(_csv(spark, ENVIRONMENT_SCHEMA, f"{base_dir}/{hemisphere}_environment.csv"))
    return df.select(
        F.lit(hemisphere).alias("hemisphere"),
        F.col("row_number").cast("int").alias("day_index"),
        "daily_max_temp_celsius",
        "daily_rainfall_mm",
    )


def day_columns(columns: Sequence[str]) -> list[str]:
    """The day columns of a wide usage table in day order."""
    found = sorted((int(m.group(1)), c) for c in columns if (m := DAY_COLUMN.match(c)))
    return [c for _, c in found]


def read_usage_matrix(spark: SparkSession, base_dir: str, hemisphere: str, numbered: bool = False) -> DataFrame:
    """Wide usage Parquet with every day column as float32."""
    df = spark.read.parquet(f"{base_dir}/{hemisphere}_water_usage.parquet")
    days = day_columns(df.columns)
    other_types = {c: F.col(c).cast("float") for c, kind in df.dtypes if c in days and kind != "float"}
    if numbered:
        df = _numbered_parquet(df)
    return df.withColumns({"hemisphere": F.lit(hemisphere)} | other_types)


def _day_numbers(days: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(DAY_COLUMN.match(c).group(1) for c in days) + ")")


def unpivot_usage(matrix: DataFrame) -> DataFrame:
    """Wide to long: one row per household and day. NULL cells were not observed and are left out.

    One generator over an array replaces a 365-fold projection list.
    """
    days = day_columns(matrix.columns)
    others = [c for c in matrix.columns if c not in days]
    long = matrix.select(*others, F.posexplode(array_of(days, "FLOAT")).alias("position", "liters"))
    return long.where(F.col("liters").isNotNull()).select(
        *others, F.get(_day_numbers(days), F.col("position")).alias("day_index"), "liters"
    )


def matrix_years(matrix: DataFrame) -> DataFrame:
    """Wide rows as parallel arrays ``day_index`` and ``liters``, other columns kept; no shuffle."""
    days = day_columns(matrix.columns)
    others = [c for c in matrix.columns if c not in days]
    return matrix.select(*others, _day_numbers(days).alias("day_index"), array_of(days).alias("liters"))


def align_by_position(household: DataFrame, matrix: DataFrame) -> DataFrame:
    """Give each row of a numbered usage matrix the key of the household in the same position."""
    return matrix.join(household.select("hemisphere", "row_number", "household_id"), ["hemisphere", "row_number"])


def load_inputs(spark: SparkSession, base_dir: str, hemispheres: Sequence[str] = HEMISPHERES) -> Inputs:
    """Read the positional layout of all hemispheres into keyed tables."""
    parts = []
    for h in hemispheres:
        household = read_household(spark, base_dir, h, numbered=True)
        matrix = read_usage_matrix(spark, base_dir, h, numbered=True)
        usage = unpivot_usage(align_by_position(household, matrix))
        parts.append(
            (
                household.drop("row_number"),
                read_environment(spark, base_dir, h),
                usage.select(*KEYS, "day_index", "liters"),
                matrix_years(matrix).select("hemisphere", "row_number", "day_index", "liters"),
                household.select(*KEYS, "row_number"),
            )
        )
    household, environment, usage, matrix, positions = (reduce(DataFrame.unionByName, tables) for tables in zip(*parts))
    return Inputs(household, environment, usage, matrix=matrix, positions=positions)


def usage_matrix(usage: DataFrame, days: int = 365) -> DataFrame:
    """Long to wide: one row per household, ``column_0`` onwards; unobserved days are NULL.

    Readings are moved to their household's task first. Widened where they lie, every task would send a whole
    year for each household it knows a day of: households times tasks.
    """
    moved = usage.select(*KEYS, "day_index", F.col("liters").cast("float").alias("liters")).repartition(*[F.col(k) for k in KEYS])
    wide = moved.groupBy(*KEYS).pivot("day_index", list(range(days))).agg(F.first("liters"))
    return wide.toDF(*KEYS, *[f"column_{d}" for d in range(days)])


def write_positional(inputs: Inputs, out_dir: str, hemispheres: Sequence[str] = HEMISPHERES, days: int = 365) -> None:
    """Write the positional layout.

    Households and usage rows are both sorted by key across all part files, so
    their order agrees. The day table is a year long and goes to one file. Usage is
    summed and widened once for all hemispheres and stored before it is sorted, as
    a sort by range runs what comes before it twice.
    """
    asked = F.col("hemisphere").isin(list(hemispheres))
    environment = materialise(inputs.environment.where(asked), "environment")
    keys = inputs.household.where(asked).select(*KEYS)
    wide = materialise(keys.join(usage_matrix(inputs.usage.where(asked), days), list(KEYS), "left"), "wide")
    for h in hemispheres:
        own = F.col("hemisphere") == h
        household = inputs.household.where(own)
        household.select(*HOUSEHOLD_SCHEMA.fieldNames()).orderBy("household_id").write.mode("overwrite").csv(
            f"{out_dir}/{h}_household.csv", header=True
        )
        environment.where(own).orderBy("day_index").select(*ENVIRONMENT_SCHEMA.fieldNames()).coalesce(1).write.mode(
            "overwrite"
        ).csv(f"{out_dir}/{h}_environment.csv", header=True)
        wide.where(own).orderBy("household_id").drop(*KEYS).write.mode("overwrite").parquet(f"{out_dir}/{h}_water_usage.parquet")


def write_keyed(df: DataFrame, path: str) -> None:
    """Write a keyed table, one folder per hemisphere."""
    df.write.partitionBy("hemisphere").mode("overwrite").parquet(path)


def write_environment(environment: DataFrame, out_dir: str) -> None:
    """Write weather as CSV with its day number, one folder per hemisphere."""
    environment.write.partitionBy("hemisphere").mode("overwrite").csv(f"{out_dir}/environment", header=True)


def read_keyed(spark: SparkSession, path: str, hemisphere: str | None = None, schema=None) -> DataFrame:
    """Read a keyed table; a hemisphere prunes to its folder."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df if hemisphere is None else df.where(F.col("hemisphere") == hemisphere)


def save_fitted(path: str, flags: DataFrame, scaler: DataFrame, variances: DataFrame, models: dict[str, KMeansModel] | None = None) -> None:
    """Persist what was fitted: day flags, scaler parameters, variance mask and k-means models."""
    flags.write.mode("overwrite").parquet(f"{path}/env_flags")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler_params")
    variances.write.mode("overwrite").parquet(f"{path}/variance_mask")
    for h, model in (models or {}).items():
        model.write().overwrite().save(f"{path}/kmeans_{h}")


def load_fitted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Day flags, scaler parameters and variance mask as saved."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("env_flags", "scaler_params", "variance_mask"))


def load_models(path: str, hemispheres: Sequence[str] = HEMISPHERES) -> dict[str, KMeansModel]:
    return {h: KMeansModel.load(f"{path}/kmeans_{h}") for h in hemispheres}


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first rows of a table."""
    return df.limit(n)


def describe_shape(name: str, df: DataFrame) -> DataFrame:
    """Row count, column count and column list."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"),
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )
