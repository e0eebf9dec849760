"""The table of named queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmeter.functions.expressions import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def publish(df: DataFrame) -> DataFrame:
    """Round every floating-point column for comparison across engines."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            (rounded(F.col(f"`{f.name}`").cast("double")) if isinstance(f.dataType, floating) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator id, with the SQL that must give the same rows."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: publish(build(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return add
